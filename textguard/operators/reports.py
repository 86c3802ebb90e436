"""Evaluation of verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.text import prefix


def outcome(truth: Column, predicted: Column) -> Column:
    """TP, TN, FP or FN."""
    return (
        F.when((truth == 1) & predicted, F.lit("TP")).when((truth == 0) & ~predicted, F.lit("TN"))
        .when((truth == 0) & predicted, F.lit("FP")).when((truth == 1) & ~predicted, F.lit("FN")))


def result_rows(df: DataFrame, row_number: str, user: str, prompt: str, truth: str, blocked: str,
                latency: str | None = None) -> DataFrame:
    """One report row per labelled prompt."""
    seconds = F.round(latency, 3) if latency else F.lit(None).cast("double")
    return df.select(
        F.col(row_number).alias("index"), F.col(user).alias("user_id"),
        prefix(F.col(prompt), rules.REPORT_CHARS).alias("prompt"),
        F.when(F.col(truth) == 1, "INJECTION").otherwise("BENIGN").alias("true_label"),
        F.col(blocked).alias("was_blocked"), outcome(F.col(truth), F.col(blocked)).alias("outcome"),
        seconds.alias("latency_s"))


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.round(F.when(denominator != 0, numerator / denominator).otherwise(0.0), 4)


def classification_report(df: DataFrame, truth: str, predicted: str, group: Sequence[str] = (),
                          latency: str | None = None, rollup: bool = False) -> DataFrame:
    """Confusion counts and rates, per group or overall, with totals by `rollup`."""
    result = outcome(F.col(truth), F.col(predicted))
    counts = [F.count_if(result == name).alias(name.lower()) for name in ("TP", "TN", "FP", "FN")]
    seconds = F.round(F.avg(latency), 3) if latency else F.lit(None).cast("double")
    grouped = df.rollup(*group) if rollup else df.groupBy(*group)
    counted = grouped.agg(F.count(F.lit(1)).alias("total_samples"), *counts, seconds.alias("avg_latency_s"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return counted.select(
        *group, "total_samples", tp.alias("true_positives"), tn.alias("true_negatives"),
        fp.alias("false_positives"), fn.alias("false_negatives"),
        _ratio(tp + tn, F.col("total_samples")).alias("accuracy"),
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1_score"),
        _ratio(fp, fp + tn).alias("false_positive_rate"), _ratio(fn, fn + tp).alias("false_negative_rate"),
        "avg_latency_s")


def category_breakdown(df: DataFrame, categories: str, result: str) -> DataFrame:
    """Matches per category and outcome, with totals (null = all)."""
    return (df.select(F.explode(categories).alias("category"), F.col(result).alias("outcome"))
            .rollup("category", "outcome").agg(F.count(F.lit(1)).alias("n")))


def worst(df: DataFrame, key: str, score: Column, n: int = 10) -> DataFrame:
    """The `n` keys with the highest total score."""
    return (df.groupBy(key).agg(F.sum(score).alias("total"), F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("total"), F.col(key)).limit(n))
