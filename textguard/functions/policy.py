"""Output policy: length, keywords, disclaimers, safety and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import text as tx


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def keywords(text: Column, dictionary: Sequence[str]) -> Column:
    """The dictionary words among the text's words, sorted.

    Words are split at white space, so a word with punctuation attached is a
    different word."""
    hits = F.sort_array(F.array_intersect(tx.words(text), _literals(dictionary)))
    may = F.lower(text).rlike("|".join(dictionary))
    return F.when(may, hits).otherwise(F.array().cast("array<string>"))


def _message(label: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.concat(F.lit(label), F.array_join(found, ", ")))


def violations(text: Column, max_length: int = rules.MAX_OUTPUT_LENGTH) -> Column:
    """Policy violations as messages, in a fixed order."""
    return F.array_compact(F.array(
        F.when(F.length(text) > max_length, F.lit(rules.LENGTH_VIOLATION)),
        _message(rules.RESTRICTED_VIOLATION, keywords(text, rules.RESTRICTED_KEYWORDS)),
        _message(rules.BLACKLIST_VIOLATION, keywords(text, rules.BLACKLISTED_KEYWORDS)),
    ))


def missing_disclaimers(text: Column, required: Sequence[str] = rules.REQUIRED_DISCLAIMERS) -> Column:
    """The required sentences that the text lacks."""
    return F.array_compact(F.array(*[F.when(~text.contains(d), F.lit(d)) for d in required]))


def is_safe_output(found_violations: Column, toxicity: Column) -> Column:
    return (F.size(found_violations) == 0) & (toxicity < rules.TOXICITY_LIMIT)


def confidence(spans: Column, found_violations: Column, toxicity: Column) -> Column:
    """1 minus 0.3 for any personal data, 0.3 for any violation, 0.4 for toxicity."""
    return 1.0 - (
        0.3 * (F.size(spans) > 0).cast("double")
        + 0.3 * (F.size(found_violations) > 0).cast("double")
        + 0.4 * (toxicity > rules.TOXICITY_DOUBT).cast("double"))
