"""Retrieval log: keyword density, frequency, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.threats import top_word_count
from textguard.functions.text import tokens


def keyword_density(text: Column) -> Column:
    """Share of the most frequent token; 0 without tokens."""
    counts = top_word_count(F.coalesce(text, F.lit("")))
    return F.when(counts["total"] > 0, counts["top"] / counts["total"]).otherwise(0.0)


def token_counts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """How often each token occurs in each row's text, counted before the shuffle."""
    return (df.select(row_id, F.explode(tokens(F.col(text))).alias("token"))
            .groupBy(row_id, "token").agg(F.count(F.lit(1)).alias("n")))


def retrieval_frequency(count: Column, window_seconds: Column) -> Column:
    """Retrievals per second, with the defaults for missing values."""
    n = F.coalesce(count, F.lit(rules.RETRIEVAL_COUNT_DEFAULT))
    seconds = F.coalesce(window_seconds, F.lit(rules.RETRIEVAL_WINDOW_DEFAULT))
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def retrieval_counts(log: DataFrame, user: str, ts: str, seconds: int = rules.RETRIEVAL_WINDOW_DEFAULT,
                     slide: int | None = None) -> DataFrame:
    """Retrievals per user and time window, with their frequency.

    Works on batches and, with a watermark on `ts`, on streams."""
    span = F.window(F.col(ts), f"{seconds} seconds", f"{slide} seconds" if slide else None)
    counted = log.groupBy(F.col(user), span.alias("_w")).agg(F.count(F.lit(1)).alias("retrieval_count"))
    return counted.select(
        user, F.col("_w.start").alias("window_start"), F.lit(seconds).alias("time_window"), "retrieval_count",
        retrieval_frequency(F.col("retrieval_count"), F.lit(seconds)).alias("retrieval_frequency"))


def priority_score(is_verified: Column, relevance: Column, trust: Column) -> Column:
    """Mean of verification, relevance and trust, with their defaults."""
    return (
        F.coalesce(is_verified, F.lit(False)).cast("double")
        + F.coalesce(relevance, F.lit(rules.RELEVANCE_DEFAULT))
        + F.coalesce(trust, F.lit(rules.TRUST_DEFAULT))) / 3.0


def is_suspicious(density: Column, frequency: Column) -> Column:
    return (density > rules.DENSITY_LIMIT) | (frequency > rules.FREQUENCY_LIMIT)


def retrieval_analysis(df: DataFrame, query: str = "query", count: str = "retrieval_count",
                       window_seconds: str = "time_window", is_verified: str = "is_verified",
                       relevance: str = "relevance_score", trust: str = "user_trust_score") -> DataFrame:
    """Add `retrieval_analysis`; columns that `df` lacks count as missing values."""
    def column(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    analysed = (
        df.withColumn("_density", keyword_density(column(query, "string")))
        .withColumn("_frequency", retrieval_frequency(column(count, "bigint"), column(window_seconds, "bigint"))))
    return analysed.withColumn("retrieval_analysis", F.struct(
        F.col("_density").alias("keyword_density"), F.col("_frequency").alias("retrieval_frequency"),
        priority_score(column(is_verified, "boolean"), column(relevance, "double"),
                       column(trust, "double")).alias("priority_score"),
        (~is_suspicious(F.col("_density"), F.col("_frequency"))).alias("is_safe"),
    )).drop("_density", "_frequency")
