"""Quality rules as a cascade that stops at the first rule a document breaks.

Each rule is a column that is true for documents to reject. `order_rules` draws a seeded
sample of about `SAMPLE_ROWS` rows of the whole table, measures the time each rule takes
there and the share it rejects, and puts the rules with the most rejections per second
first; `cascade` evaluates them in that order, each one only for documents that the
earlier ones let pass. The order changes
speed only: a document is kept if no rule rejects it, whatever the order.

All rules are built-in functions on the row itself: no shuffle, no key that could be
hot, no state. Null texts are empty, have no words and fail `few_words`. Other columns
are passed through as they are, whatever their names; ties and repeated rows get the
same verdict; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.llm.words import count_of, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
WINDOW = 5
#: Rows on which a rule's rejections are counted, and bytes of them on which it is timed.
SAMPLE_ROWS, TIMED_BYTES = 10_000, 4 * 2**20
#: Seconds that stand out from the noise of a job.
ENOUGH = 0.1


@dataclass(frozen=True)
class Rule:
    """`reject` is built from the columns of `measures`, evaluated when it is reached."""

    name: str
    reject: Column


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(text) - count_of(text, "\\x20\\x09-\\x0D")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _windows(words: Column) -> Column:
    """A 64-bit hash for each window of five words, in order of place: of two fours, each of two pairs."""
    def shifted(x: Column, by: int) -> Column:
        n = F.greatest(F.size(x) - by, F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(x, by + 1, n), lambda a, b: F.xxhash64(a, b))

    return let(let(shifted(words, 1), lambda pairs: shifted(pairs, 2)), lambda fours: shifted(fours, 1))


def _covered(windows: Column) -> Column:
    """Words that lie in a window found twice: windows are sorted by hash, those equal to
    a neighbour are put back in order of place, and each covers up to the next one's start.
    Sorting only, so a text of any length takes n log n steps."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(order: Column) -> Column:
        rest = F.greatest(F.size(order) - 1, F.lit(0))
        near = F.arrays_zip(
            order.alias("o"), F.concat(none, F.slice(order, 1, rest)).alias("b"),
            F.concat(F.slice(order, 2, rest), none).alias("a"))
        same = F.filter(near, lambda z: (z["o"]["h"] == z["b"]["h"]) | (z["o"]["h"] == z["a"]["h"]))
        return F.sort_array(F.transform(same, lambda z: z["o"]["i"]))

    def total(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))),
                          lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda so_far, g: so_far + g)

    return let(let(pairs, again), total)


def _repeat_words(words: Column) -> Column:
    return let(_windows(words), lambda windows: F.when(
        F.size(F.array_distinct(windows)) < F.size(windows), _covered(windows)).otherwise(F.lit(0).cast("long")))


def n_repeat_words(text: Column) -> Column:
    """Words in windows of five words that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes within one text."""
    return let(words_of(text), _repeat_words)


MEASURES = {
    "n_words": n_words, "word_chars": word_chars,
    "n_symbols": lambda text: count_of(text, SYMBOLS), "n_capitals": lambda text: count_of(text, CAPITALS),
    "n_lines": lambda text: F.size(_lines(text)).cast("long"), "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


def rules(m: dict[str, Column]) -> list[Rule]:
    """The default rules, over measures given as columns or as expressions on the text."""
    return [
        Rule("few_words", m["n_words"] < 10),
        Rule("odd_word_length", (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
        Rule("symbols", 10 * m["n_symbols"] > m["n_words"]),
        Rule("capitals", 2 * m["n_capitals"] > m["word_chars"]),
        Rule("dup_lines", (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
        Rule("repeats", 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ]


def text_rules(text: str = "text") -> list[Rule]:
    """The default rules, each computing only what it needs from the text."""
    column = text_of(F.col(text))
    return rules({name: measure(column) for name, measure in MEASURES.items()})


def sample_of(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows, each with equal odds, stored; all rows of a smaller table."""
    total = docs.count()
    return durable(docs if total <= rows else docs.sample(fraction=rows / total, seed=seed))


def costs(sample: DataFrame, todo: Sequence[Rule], text: str = "text", timed: int = TIMED_BYTES, runs: int = 2) -> dict[str, float]:
    """Seconds of one core each rule takes over about `timed` bytes of the stored sample (or all, if it
    has fewer), in one task: the least of several runs counts, less what the same job takes that
    only reads the texts. Where that is too little to measure, every row goes through several times."""
    size = sample.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] or 1
    some = sample.sample(fraction=timed / size, seed=7) if size > timed else sample
    some = durable(some.coalesce(1))
    most = max(1, min(timed // size, 512))
    empty: dict[int, float] = {}

    def seconds(reject: Column, copies: int) -> float:
        rows = some.coalesce(1).select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy"))
        found = []
        for _ in range(runs + 1):  # the first run compiles
            start = time.perf_counter()
            rows.agg(F.count_if(reject)).collect()
            found.append(time.perf_counter() - start)
        return min(found[1:])

    def cost(rule: Rule) -> float:
        copies = 1
        while True:
            if copies not in empty:
                empty[copies] = seconds(F.octet_length(text) < 0, copies)
            own = seconds(rule.reject, copies) - empty[copies]
            if own >= ENOUGH or copies == most:
                return max(own, 5e-3) / copies
            copies = min(most, copies * 16)

    return {rule.name: cost(rule) for rule in todo}


def ranked(sample: DataFrame, todo: Sequence[Rule], text: str = "text") -> list[Rule]:
    """Rules by rejections per second on a stored sample, best first. Gains are rounded to powers
    of four, and rules alike in them stay in the order given."""
    seconds = costs(sample, todo, text)
    total, *counts = sample.agg(F.count("*"), *[F.count_if(rule.reject) for rule in todo]).first()
    gain = {rule.name: (n + 1) / (total + 2) / seconds[rule.name] for rule, n in zip(todo, counts, strict=True)}
    return sorted(todo, key=lambda rule: -round(math.log2(gain[rule.name]) / 2))


def order_rules(docs: DataFrame, todo: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of about `sample_rows` rows, best first."""
    return ranked(sample_of(docs, sample_rows), todo, text)


def broken(ordered: Sequence[Rule]) -> Column:
    """Name of the first rule in this order that rejects the row; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        out = F.when(rule.reject, F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    ordered = order_rules(docs.select(text), text_rules(text), text, sample_rows)
    return docs.where(broken(ordered).isNull())


def measured(docs: DataFrame, doc: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (too few
    words, or too many of them in repeated windows) and kept: base_failed documents go without
    more ado, the rest run the cascade. What rules need besides the columns named is computed on
    the text when its rule is reached, so only for documents that no earlier rule rejects."""
    named = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    column = text_of(F.col("text"))
    both = let(words_of(column), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words")))

    def with_measures(source: DataFrame) -> DataFrame:
        return source.select("*", both.alias("both"), *[
            MEASURES[name](column).alias(name) for name in named if name not in ("n_words", "n_repeat_words")]).select("*", "both.*")

    source = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    by_name = {rule.name: rule for rule in rules({
        name: F.col(name) if name in named else measure(column) for name, measure in MEASURES.items()})}
    failed = by_name["few_words"].reject | by_name["repeats"].reject
    rest = [rule for name, rule in by_name.items() if name not in ("few_words", "repeats")]
    # A rule costs what it adds to the columns that are there in any case.
    ordered = ranked(durable(with_measures(sample_of(source.select("text"), sample_rows))), rest)
    return with_measures(source).select(
        "doc_id", *named, failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(broken(ordered).isNull()).alias("kept"))
