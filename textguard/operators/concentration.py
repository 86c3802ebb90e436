"""Score arrays: concentration, spread, extreme values, correlated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import vectors as vec


def array_distribution_stats(df: DataFrame, column: str) -> DataFrame:
    """One row over all arrays: mean entropy of their absolute values, mean and
    deviation of all values, and statistics of the lengths.

    Each array is summed up where it is; only sums are shuffled."""
    values = vec.doubles(F.col(column))
    per_row = df.where(F.col(column).isNotNull()).select(
        F.size(column).alias("_n"),
        vec.entropy(F.transform(values, F.abs)).alias("_entropy"),
        F.aggregate(values, F.lit(0.0), lambda t, x: t + x).alias("_sum"),
        F.aggregate(values, F.lit(0.0), lambda t, x: t + x * x).alias("_squares"),
        F.array_min(values).alias("_min"), F.array_max(values).alias("_max"))
    total = F.sum("_n")
    mean = F.sum("_sum") / total
    return per_row.agg(
        F.count(F.lit(1)).alias("samples"), F.avg("_entropy").alias("mean_attention_entropy"),
        mean.alias("value_mean"),
        F.sqrt(F.greatest(F.sum("_squares") / total - mean * mean, F.lit(0.0))).alias("value_std"),
        F.min("_min").alias("value_min"), F.max("_max").alias("value_max"),
        F.avg("_n").alias("length_mean"), F.max("_n").alias("length_max"))


def activation_check(df: DataFrame, weights: str, rows: Column, value_mean: Column, value_std: Column,
                     values: str) -> DataFrame:
    """Add `activation_check` for a weight array, a matrix of attention rows and
    an array of values, against the mean and deviation of known values."""
    w = F.transform(vec.doubles(F.col(weights)), F.abs)
    extreme = F.array_max(F.transform(
        vec.doubles(F.col(values)), lambda x: F.abs(x - value_mean) / F.greatest(value_std, F.lit(1e-9))))
    marked = (
        df.withColumn("_concentration", vec.concentration(w)).withColumn("_entropy", vec.entropy(w))
        .withColumn("_z", extreme)
        .withColumn("_correlation", vec.mean_row_correlation(rows, F.size(rows)))
        .withColumn("_long", F.size(values) > rules.MAX_SEQUENCE))
    kind = (
        F.when(F.col("_concentration") > rules.ATTENTION_CONCENTRATION, F.lit("attention_concentration"))
        .when(F.col("_z") > rules.EXTREME_Z, F.lit("extreme_values"))
        .when(F.col("_correlation") > rules.ATTENTION_CORRELATION, F.lit("correlated_attention")))
    return marked.withColumn("activation_check", F.struct(
        kind.isNotNull().alias("is_poisoned"), kind.alias("anomaly_type"),
        F.col("_concentration").alias("concentration"), F.col("_entropy").alias("entropy"),
        F.col("_z").alias("activation_score"), F.col("_correlation").alias("attention_correlation_score"),
        F.col("_long").alias("sequence_length_warning"),
    )).drop("_concentration", "_entropy", "_z", "_correlation", "_long")
