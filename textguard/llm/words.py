"""Columns shared by the operators: words, ASCII lower case, tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of other characters than white space."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def count_of(text: Column, chars: str) -> Column:
    """How many code points of the text are in the character class `chars`."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]
