"""Vector baseline (mean, covariance, norms) and outliers against it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard import rules
from textguard.durable import shuffle_parts
from textguard.functions import vectors as vec
from textguard.functions.text import once

MOMENTS = ("dim int, n long, mean array<double>, scatter array<double>, "
           "norm_mean double, norm_scatter double")
_STD_FLOOR = 1e-6
_FAN_IN = 32
_MAX_CONDITION = 1e12


def _moments_fold(merge: bool):
    """A `mapInArrow` function giving one row of moments per vector dimension.

    Input is vectors, or with `merge` such rows.  Moments are centred, so they
    combine without cancellation: the scatter (sum of outer products around the
    mean) of two parts is the sum of theirs plus that of their means."""
    arrow = pa.schema([
        ("dim", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
        ("scatter", pa.list_(pa.float64())), ("norm_mean", pa.float64()), ("norm_scatter", pa.float64())])

    def combine(a, b):
        if a is None:
            return b
        n = a[0] + b[0]
        delta, weight = b[1] - a[1], a[0] * b[0] / n
        norm_delta = b[3] - a[3]
        return (n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * weight,
                a[3] + norm_delta * (b[0] / n), a[4] + b[4] + norm_delta * norm_delta * weight)

    def of_vectors(column):
        sizes = pc.list_value_length(column)
        for dim in pc.unique(sizes.drop_null()).to_pylist():
            if dim == 0:
                continue
            same = column.filter(pc.fill_null(pc.equal(sizes, dim), False))
            rows = same.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            mean, norms = rows.mean(axis=0), np.linalg.norm(rows, axis=1)
            centred = rows - mean
            yield dim, (len(rows), mean, centred.T @ centred, norms.mean(),
                        float(((norms - norms.mean()) ** 2).sum()))

    def of_rows(batch):
        for row in batch.to_pylist():
            dim = row["dim"]
            yield dim, (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(dim, dim),
                        row["norm_mean"], row["norm_scatter"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for dim, part in of_rows(batch) if merge else of_vectors(batch.column(0)):
                totals[dim] = combine(totals.get(dim), part)
        for dim, (n, mean, scatter, norm_mean, norm_scatter) in totals.items():
            yield pa.RecordBatch.from_pylist([{
                "dim": dim, "n": n, "mean": mean.tolist(), "scatter": scatter.ravel().tolist(),
                "norm_mean": float(norm_mean), "norm_scatter": float(norm_scatter)}], arrow)

    return fold


def vector_moments(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row per vector dimension: count, mean, scatter matrix, norm moments.

    Each task sends one d x d matrix; see `merge_moments`."""
    return merge_moments(df.select(embedding).mapInArrow(_moments_fold(merge=False), MOMENTS))


def merge_moments(moments: DataFrame) -> DataFrame:
    """Moments of several parts as those of the whole, also for growing a baseline
    without reading the old vectors again.

    A tree: the configured number of shuffle tasks first, then a `_FAN_IN`-th of
    them each time, with an exchange in between.  A task merges its rows one at a
    time, so it holds two matrices, and the last one gets at most `_FAN_IN`."""
    tasks = shuffle_parts(moments.sparkSession)
    while True:
        moments = moments.repartition(tasks).mapInArrow(_moments_fold(merge=True), MOMENTS)
        if tasks == 1:
            return moments
        tasks = -(-tasks // _FAN_IN)


def baseline_from(moments: DataFrame, min_samples: int = rules.MIN_BASELINE_DOCS) -> DataFrame:
    """Mean, sample covariance, mean and population deviation of the norms; no
    row for a dimension with fewer than `min_samples` vectors."""
    rows = F.transform(
        F.sequence(F.lit(0), F.col("dim") - 1),
        lambda i: F.transform(F.slice("scatter", i * F.col("dim") + 1, F.col("dim")), lambda x: x / (F.col("n") - 1)))
    return moments.where((F.col("n") >= min_samples) & (F.col("n") > 1)).select(
        "dim", F.col("n").alias("total_documents"), "mean", rows.alias("covariance"),
        F.col("norm_mean"), F.sqrt(F.col("norm_scatter") / F.col("n")).alias("norm_std"))


def vector_baseline(df: DataFrame, embedding: str = "embedding",
                    min_samples: int = rules.MIN_BASELINE_DOCS) -> DataFrame:
    return baseline_from(vector_moments(df, embedding), min_samples)


def _distances(models: dict):
    """An Arrow function from vectors to (norm z-score, Mahalanobis distance, whether
    the model's covariance is usable); null where no model has the vector's dimension,
    and without a distance where its covariance has no inverse."""
    def measure(vectors: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(vectors)
        z_scores = np.full(len(vectors), np.nan)
        distances = np.full(len(vectors), np.nan)
        known, usable = np.zeros(len(vectors), bool), np.zeros(len(vectors), bool)
        for dim, (mean, inverse, norm_mean, norm_std) in models.items():
            mask = pc.fill_null(pc.equal(sizes, dim), False)
            where = mask.to_numpy(zero_copy_only=False)
            if not where.any():
                continue
            rows = vectors.filter(mask).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            z_scores[where] = np.abs(np.linalg.norm(rows, axis=1) - norm_mean) / norm_std
            known |= where
            if inverse is not None:
                usable |= where
                diff = rows - mean
                distances[where] = np.sqrt(np.maximum(np.einsum("ij,ij->i", diff @ inverse, diff), 0.0))
        return pa.StructArray.from_arrays(
            [pa.array(z_scores, mask=np.isnan(z_scores)), pa.array(distances, mask=np.isnan(distances)),
             pa.array(usable, mask=~known)], ["z_score", "mahalanobis", "baseline_usable"])

    kind = T.StructType([T.StructField("z_score", T.DoubleType()), T.StructField("mahalanobis", T.DoubleType()),
                         T.StructField("baseline_usable", T.BooleanType())])
    return F.arrow_udf(measure, kind)


def _models(baseline: Sequence[Row], ridge: float) -> dict:
    """Inverse covariances, computed once; None where the covariance has none."""
    models = {}
    for row in baseline:
        covariance = np.array(row["covariance"]) + ridge * np.eye(row["dim"])
        usable = np.linalg.cond(covariance) < _MAX_CONDITION
        inverse = np.linalg.inv(covariance) if usable else None
        models[row["dim"]] = (np.array(row["mean"]), inverse, row["norm_mean"], max(row["norm_std"], _STD_FLOOR))
    return models


def _with_distances(df: DataFrame, baseline: Sequence[Row], embedding: str, ridge: float) -> DataFrame:
    measure = _distances(_models(baseline, ridge))
    return (once(df, "_d", measure(F.col(embedding)))
            .withColumns({c: F.col(f"_d.{c}") for c in ("z_score", "mahalanobis", "baseline_usable")}).drop("_d"))


def vector_distances(df: DataFrame, baseline: DataFrame, embedding: str = "embedding",
                     ridge: float = 0.0) -> DataFrame:
    """Add `z_score` of the norm and `mahalanobis`; nulls without a baseline.
    `baseline_usable` is false, and the distance null, where the covariance has no
    inverse (for example with no more vectors than dimensions).

    The baseline (one row per dimension) comes to the driver for its inverse and
    goes out with the task; its size depends on the dimension alone.  `ridge` is
    added to the variances, for fewer vectors than dimensions."""
    return _with_distances(df, baseline.collect(), embedding, ridge)


def vector_anomalies(df: DataFrame, baseline: DataFrame, embedding: str = "embedding",
                     threshold: float | None = None, ridge: float = 0.0) -> DataFrame:
    """Add `anomaly_score` (the larger of norm z-score and Mahalanobis distance)
    and `is_anomaly`; (0, false) without a baseline.  Where `baseline_usable` is
    false, the norm alone decides.

    Distances grow with the square root of the dimension, so the default
    threshold does too; pass `rules.ANOMALY_THRESHOLD` for the fixed one."""
    limit = F.lit(threshold) if threshold is not None else poison_threshold(F.col(embedding))
    scored = vector_distances(df, baseline, embedding, ridge)
    return (scored.withColumn("anomaly_score", F.coalesce(F.greatest("z_score", "mahalanobis"), F.lit(0.0)))
            .withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > limit, F.lit(False)))
            .drop("z_score", "mahalanobis"))


def poison_threshold(embedding: Column, sensitivity: float = rules.POISON_SENSITIVITY) -> Column:
    return sensitivity * F.sqrt(F.size(embedding))


def vector_poisoning(df: DataFrame, safe: DataFrame, embedding: str = "embedding",
                     sensitivity: float = rules.POISON_SENSITIVITY,
                     min_samples: int = rules.MIN_SAFE_SAMPLES, ridge: float = 0.0,
                     retrieval: str | None = None) -> DataFrame:
    """Add `poisoning_detection`: distance from the safe vectors, verdict, and
    similarity to their mean (cosine, scaled to 0..1).  `retrieval` names a
    column of retrieval statistics to carry in the result."""
    baseline = vector_baseline(safe, embedding, min_samples).collect()
    mean = F.coalesce(*[
        F.when(F.size(embedding) == row["dim"], F.array(*[F.lit(x) for x in row["mean"]])) for row in baseline],
        F.lit(None).cast("array<double>"))
    similarity = (1.0 + vec.cosine(F.col(embedding), mean)) / 2.0
    scored = _with_distances(df, baseline, embedding, ridge)
    stats = F.col(retrieval) if retrieval else F.lit(None).cast("string")
    return scored.withColumn("poisoning_detection", F.struct(
        F.coalesce(F.col("mahalanobis") > poison_threshold(F.col(embedding), sensitivity), F.lit(False)).alias("is_poisoned"),
        F.coalesce(F.col("mahalanobis"), F.lit(0.0)).alias("mahalanobis_distance"),
        similarity.alias("similarity_score"), stats.alias("retrieval_stats"),
        F.coalesce("baseline_usable", F.lit(False)).alias("baseline_usable"),
    )).drop("z_score", "mahalanobis", "baseline_usable")


def refreshed_moments(moments: DataFrame, checked: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Moments grown by the vectors of `checked` that are not poisoned."""
    clean = checked.where(~F.col("poisoning_detection.is_poisoned"))
    return merge_moments(moments.unionByName(vector_moments(clean, embedding)))
