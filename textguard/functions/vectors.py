"""Vectors held as ARRAY<FLOAT> or ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda total, x: total + x * x))


def cosine_of(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a dot product and two norms; 0 if a norm is 0."""
    return F.when((norm_a > 0) & (norm_b > 0), product / (norm_a * norm_b)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b))


def layer3_score(vector: Column, mean: Column | None, scale: float, cap: float) -> Column:
    """Squared length of the scaled distance to the mean, capped; null without a vector."""
    values = doubles(vector)
    diff = values if mean is None else F.zip_with(values, mean, lambda x, m: x - m)
    length = F.aggregate(diff, F.lit(0.0), lambda total, x: total + (F.lit(scale) * x) * (F.lit(scale) * x))
    return F.when(vector.isNotNull(), F.least(length, F.lit(cap)))


def concentration(weights: Column) -> Column:
    """Share of the largest weight; 0 if all are 0."""
    total = _total(doubles(weights))
    return F.when(total > 0, F.array_max(doubles(weights)) / total).otherwise(0.0)


def entropy(weights: Column) -> Column:
    """Entropy (nats) of weights read as a distribution; 0 if all are 0."""
    values = F.filter(doubles(weights), lambda x: x > 0)
    total = _total(values)
    # -sum(p ln p) with p = x / total
    weighted = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * F.ln(x))
    return F.when(total > 0, F.ln(total) - weighted / total).otherwise(0.0)


def standardized(row: Column) -> Column:
    """A row centred and scaled to unit length; zeros if it is constant."""
    values = doubles(row)
    mean = _total(values) / F.size(values)
    centred = F.transform(values, lambda x: x - mean)
    length = norm(centred)
    return F.transform(centred, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def mean_row_correlation(rows: Column, row_count: Column) -> Column:
    """Mean Pearson correlation over all pairs of rows, without forming the pairs.

    With rows scaled to unit length, the products over all ordered pairs add up
    to the squared length of their sum, less one for each row with itself."""
    units = F.transform(rows, standardized)
    zeros = F.transform(F.element_at(units, 1), lambda _: F.lit(0.0))
    total = F.aggregate(units, zeros, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    own = F.aggregate(F.flatten(units), F.lit(0.0), lambda acc, x: acc + x * x)
    square = F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(row_count > 1, (square - own) / (row_count * (row_count - 1))).otherwise(0.0)


def reshape(vector: Column, width: int) -> Column:
    """A flat vector as rows of `width` values."""
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(width))
    return F.transform(starts, lambda i: F.slice(vector, i, width))
