"""Text columns: cleaning, character classes, tokens, chunks.

Patterns run with `(?dU)`: `U` gives `\\w \\s \\b \\d` their Unicode meaning, `d`
keeps `.` matching everything but a newline.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard import rules

# Java's `\s` is ASCII, so the class is spelt out.
_SPACE = rules.WHITESPACE
#: Texts that an Arrow function works on at once.
PIECE_BYTES = 1 << 20


def pattern(body: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A pattern with the flags every rule here is meant to run with."""
    return f"(?d{'i' if ignore_case else ''}{'m' if multiline else ''}U){body}"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (`trim` knows only U+0020)."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def words(text: Column) -> Column:
    """Lower-cased words between white space; punctuation stays attached."""
    return F.filter(F.split(F.lower(text), f"{_SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def in_pieces(function: Callable[[pa.Array], pa.Array], size: int = PIECE_BYTES) -> Callable[[pa.Array], pa.Array]:
    """An Arrow function that works on its texts in pieces of about `size` bytes (and a text
    more), so that what it holds besides its input and result does not grow with a batch's texts."""
    def pieces(texts: pa.Array) -> pa.Array:
        if texts.nbytes <= size:
            return function(texts)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // size)) + 1
        cuts = [0, *places.tolist(), len(texts)]
        return pa.concat_arrays([function(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return pieces


def _normalizer():
    def normalize(texts: pa.Array) -> pa.Array:
        # Not pc.utf8_normalize: it leaves letters decomposed.
        return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return in_pieces(normalize)


# Arrow functions are closures, so that they travel to executors by value.
_nfkc = F.arrow_udf(_normalizer(), T.StringType())


def once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """`df` with a costly column that is computed once per row, whatever uses it above.

    Filters that do not look at it are still pushed below it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def nfkc(text: Column) -> Column:
    """NFKC form.  Spark has no such function, so non-ASCII texts go through
    Arrow; ASCII texts are their own NFKC form and are sent as nulls."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean(text: Column, fold_homoglyphs: bool = False) -> Column:
    """Drop control, zero-width and bidi characters, collapse white space.

    Control characters vanish without a space, so words around a newline fuse.
    Cyrillic look-alikes are their own NFKC form and therefore stay, unless
    `fold_homoglyphs` asks for their Latin twins.
    """
    dropped = f"[{rules.CONTROL_CHARS}{rules.ZERO_WIDTH}{rules.BIDI_CONTROLS}]+"
    out = F.regexp_replace(text, dropped, "")
    if fold_homoglyphs:
        twins = rules.HOMOGLYPH_TWINS
        out = F.translate(out, "".join(twins), "".join(twins.values()))
    # Only what is not already a single U+0020 needs replacing.
    out = F.regexp_replace(out, f"{_SPACE}{{2,}}|[{_SPACE}&&[^ ]]", " ")
    return F.trim(out)


def char_class_score(text: Column) -> Column:
    """Share of the five character classes that occur in the text."""
    classes = (
        rules.CONTROL_CHARS, rules.ZERO_WIDTH, rules.HOMOGLYPHS,
        rules.BIDI_CONTROLS, _SPACE,
    )
    hits = sum((text.rlike(c).cast("int") for c in classes), F.lit(0))
    return hits / F.lit(float(len(classes)))


def is_trivial_prompt(text: Column) -> Column:
    """At most ten characters, all letters or white space; empty counts."""
    short = strip(text)
    return (F.length(short) <= rules.TRIVIAL_LENGTH) & short.rlike(rf"^(?:\p{{L}}|{_SPACE})*$")


def is_trivial_turn(text: Column) -> Column:
    """At most ten characters, only letters once U+0020 is gone; empty does not count."""
    short = strip(text)
    return (F.length(short) <= rules.TRIVIAL_LENGTH) & F.replace(short, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")


def exit_probability(*scores: Column) -> Column:
    """Sigmoid of the highest layer score (each capped at 10)."""
    capped = [F.least(s, F.lit(10.0)) for s in scores]
    top = F.greatest(*capped) if len(capped) > 1 else capped[0]
    return 1.0 / (1.0 + F.exp(-rules.EXIT_SLOPE * (top - rules.EXIT_THETA)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared share of two word arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def chunks(text: Column, size: int = rules.CHUNK_SIZE) -> Column:
    """The text cut into pieces of `size` characters, the last one shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def array_chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of `size`, the last one shorter; empty stays empty."""
    starts = F.sequence(F.lit(1), F.size(items), F.lit(size))
    pieces = F.transform(starts, lambda i: F.slice(items, i, size))
    return F.when(F.size(items) > 0, pieces).otherwise(F.filter(F.array(items), lambda _: F.lit(False)))


def prefix(text: Column, size: int) -> Column:
    """The first characters, as shown in reports or fed to a bounded classifier."""
    return F.substring(text, 1, size)
