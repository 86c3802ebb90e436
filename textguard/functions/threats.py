"""Input checks: length, malicious patterns, characters, repetition, look-alikes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import text as tx


def length_exceeded(text: Column, limit: int = rules.MAX_INPUT_LENGTH) -> Column:
    return F.length(text) > limit


def malicious_patterns(text: Column) -> Column:
    """Names of the attack patterns found, in table order."""
    return F.array_compact(F.array(*[
        F.when(text.rlike(tx.pattern(body, ignore_case=True)), F.lit(name))
        for name, body in rules.MALICIOUS_PATTERNS]))


def character_threats(text: Column) -> Column:
    """Names of the dangerous characters found, in table order."""
    return F.array_compact(F.array(*[
        F.when(text.rlike(body), F.lit(name)) for name, body in rules.CHARACTER_THREATS]))


def has_homoglyph(text: Column) -> Column:
    """Whether one of the twelve known look-alikes occurs."""
    return text.rlike(rules.HOMOGLYPHS)


def mixed_script_words(text: Column) -> Column:
    """Words that mix Latin and Cyrillic letters, in order of occurrence."""
    words = F.split(text, r"[^\p{L}\p{N}.\-]+")
    mixed = F.filter(words, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"\p{IsCyrillic}"))
    return F.when(text.rlike(r"\p{IsCyrillic}"), mixed).otherwise(F.array().cast("array<string>"))


def top_word_count(text: Column) -> Column:
    """How often the most frequent token occurs: `STRUCT<top INT, total INT>`.

    Sorting brings equal tokens together, so one pass over the runs suffices."""
    sorted_tokens = F.sort_array(tx.tokens(text))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(acc["word"] == word, acc["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    top = F.aggregate(sorted_tokens, start, step, lambda acc: acc["top"])
    return F.struct(top.alias("top"), F.size(sorted_tokens).alias("total"))


def repetition(text: Column) -> Column:
    """Whether one character runs on, or one word makes up most of the text."""
    counts = top_word_count(text)
    words = (counts["total"] >= rules.REPEATED_WORD_MIN) & (
        counts["top"] / counts["total"] >= rules.REPEATED_WORD_SHARE)
    return text.rlike(rf"(\S)\1{{{rules.REPEATED_CHARS - 1},}}") | words


def context_warnings(user_id: Column, timestamp_text: Column) -> Column:
    """What is wrong with a request's context."""
    return F.array_compact(F.array(
        F.when(user_id.isNull(), F.lit("missing_user")),
        F.when(timestamp_text.isNull(), F.lit("missing_timestamp")),
        F.when(timestamp_text.isNotNull() & F.try_to_timestamp(timestamp_text).isNull()
               & timestamp_text.cast("string").try_cast("bigint").isNull(), F.lit("invalid_timestamp"))))
