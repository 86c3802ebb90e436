"""Injection rules as columns.

Matching 88 patterns one after the other is by far the dearest step of this
library, and most texts match none.  The matching therefore runs over Arrow
batches with a DFA engine, in three sieves: all rules as one alternation, whose
cost hardly depends on their number; then rule by rule, on the texts left; and
last the rule as written, on the few pairs of text and rule left.  The first two
let through whatever could match, so the last one alone decides.

Its result comes out of a one-element `explode` (`once`): filters on plain columns
and partitions go below that, wherever they stand, while filters on the score stay
above it, so that no text is matched a second time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard import rules
from textguard.functions.text import in_pieces, once

# A case-blind match also equates these with i, i, s and k.
_CASE_TWINS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


def lower_pattern(body: str) -> str:
    """The pattern with its literals in lower case; escapes like `\\S` stay."""
    return re.sub(r"\\.|[^\\]+", lambda m: m.group() if m.group()[0] == "\\" else m.group().lower(), body)


def widened(body: str) -> str:
    """A pattern in RE2's dialect that matches the lower-case form of every text
    `body` matches without regard to case.

    RE2 knows `\\s \\w \\b` for ASCII only, so they are widened: `\\s` to all
    separators, `\\w` to anything but white space, and a final `\\b` to "or a
    character beyond ASCII follows".  Elsewhere `\\b` stands next to an ASCII
    letter, where an edge in the Unicode sense is also one in the ASCII sense.
    """
    body = re.sub(r"\\b$", r"(?:\\b|[^\\x00-\\x7f])", lower_pattern(body))
    body = body.replace(r"\s", r"[\s\v\x1c-\x1f\x{85}\pZ]").replace(r"\w", r"\S")
    return re.sub(r"\((?!\?)", "(?:", body)


def _matcher():
    """The three sieves as an Arrow function from texts to rule numbers."""
    table = [
        (widened(body), body, re.MULTILINE if i in rules.CASE_SENSITIVE else re.IGNORECASE)
        for i, (_, _, body) in enumerate(rules.INJECTION_RULES)]
    # `^` would be the start of the text here; the rule's other lead-ins need no sieve.
    table = [(wide.replace(r"(?:^|\n|\.|\?|!)", ""), body, flags) for wide, body, flags in table]
    any_rule = "|".join(wide for wide, _, _ in table)
    twins = dict(_CASE_TWINS)

    def match(texts: pa.Array) -> pa.Array:
        folded = texts
        for char, twin in twins.items():
            folded = pc.replace_substring(folded, pattern=char, replacement=twin)
        folded = pc.utf8_lower(folded)
        may = pc.fill_null(pc.match_substring_regex(folded, pattern=any_rule), False)
        left = np.nonzero(may.to_numpy(zero_copy_only=False))[0]
        found: list[list[int]] = [[] for _ in range(len(texts))]
        if len(left):
            folded, raw = folded.take(pa.array(left)), texts.take(pa.array(left)).to_pylist()
            for number, (wide, body, flags) in enumerate(table, start=1):
                pairs = pc.match_substring_regex(folded, pattern=wide).to_numpy(zero_copy_only=False)
                for i in np.nonzero(pairs)[0]:
                    if re.search(body, raw[i], flags):
                        found[left[i]].append(number)
        return pa.array(found, pa.list_(pa.int32()))

    return in_pieces(match)


matched_rules = F.arrow_udf(_matcher(), T.ArrayType(T.IntegerType()))


def _looked_up(numbers: str, values: list[str]) -> Column:
    """The values at the given places of a literal table."""
    return F.expr(f"transform({numbers}, n -> element_at(array({', '.join(values)}), n))")


def injection_score(df: DataFrame, column: str) -> DataFrame:
    """Add `injection_score` (each rule counts once, however often it matches),
    `matched_categories` (in rule order) and `is_injection`."""
    weights = _looked_up("_rules", [f"{weight}D" for _, weight, _ in rules.INJECTION_RULES])
    categories = _looked_up("_rules", [f"'{category}'" for category, _, _ in rules.INJECTION_RULES])
    return (
        once(df, "_rules", matched_rules(F.col(column)))
        .withColumn("injection_score", F.aggregate(weights, F.lit(0.0), lambda total, w: total + w))
        .withColumn("matched_categories", F.array_distinct(categories))
        .withColumn("is_injection", F.col("injection_score") >= rules.INJECTION_THRESHOLD)
        .drop("_rules")
    )


def add_model_score(df: DataFrame, label: str, confidence: str) -> DataFrame:
    """Add a classifier's verdict to the columns of `injection_score`.

    The category is noted whenever the label says INJECTION and the total
    reaches the threshold, even if the confidence added nothing.
    """
    says_injection = F.coalesce(F.upper(F.col(label)) == "INJECTION", F.lit(False))
    band = F.lit(0.0)
    for floor, points in reversed(rules.MODEL_BANDS):
        band = F.when(F.col(confidence) >= floor, F.lit(points)).otherwise(band)
    noted = says_injection & (F.col("injection_score") >= rules.INJECTION_THRESHOLD)
    with_model = F.array_union("matched_categories", F.array(F.lit(rules.MODEL_CATEGORY)))
    return (
        df.withColumn("injection_score",
                      F.col("injection_score") + F.when(says_injection, band).otherwise(0.0))
        .withColumn("matched_categories",
                    F.when(noted, with_model).otherwise(F.col("matched_categories")))
        .withColumn("is_injection", F.col("injection_score") >= rules.INJECTION_THRESHOLD)
    )


def injection_reason(score: Column, categories: Column) -> Column:
    return F.format_string("Injection patterns detected (score: %.1f, categories: %s)",
                           score, F.array_join(categories, ", "))


def prompt_risk(score: Column) -> Column:
    """The score scaled so that one unambiguous rule means full risk."""
    return F.least(score / 3.0, F.lit(1.0))
