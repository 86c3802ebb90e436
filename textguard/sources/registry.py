"""The document registry as stored files: buckets of documents, and versions that name their files.

A batch of updates touches the buckets its documents hash to; only those are merged and
written again, into files of their own. A version names the files of all buckets and is
entered last (`versions.commit`), so readers see all of a batch or nothing, and a second
writer of the same version is refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.operators.integrity import upsert
from textguard.sources import versions

BUCKETS = 256
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Staged:
    """Updates merged and written, but not yet part of a version."""

    spark: SparkSession
    path: str
    base: int
    content: dict[str, str]


def read_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None if nothing was ever written."""
    return versions.read(spark, path)[1]


def stage(updates: DataFrame, path: str, doc_id: str = "doc_id", buckets: int = BUCKETS) -> Staged:
    """Merge updates with the touched buckets of the newest version and write these.

    The number of buckets is that of the first version; later ones keep it."""
    spark = updates.sparkSession
    known = versions.newest(spark, path)
    content = dict(known.content) if known else {}
    base = known.number if known else 0
    first = next(iter(content), f"bucket 0 of {buckets}")
    buckets = int(first.rsplit(" ", 1)[1])
    rows = durable(updates.withColumn(_BUCKET, F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")))
    touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # at most `buckets`
    names = {b: f"bucket {b} of {buckets}" for b in touched}
    old = [content[name] for name in names.values() if name in content]
    merged = rows.drop(_BUCKET)
    if old:
        merged = upsert(spark.read.parquet(*[f"{path}/data/{f}" for f in old]), merged, doc_id)
    else:
        merged = upsert(merged.where("false"), merged, doc_id)
    writer = uuid.uuid4().hex
    merged.withColumn(_BUCKET, F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")).repartition(_BUCKET).write.partitionBy(
        _BUCKET).parquet(f"{path}/data/{writer}")
    return Staged(spark, path, base, content | {name: f"{writer}/{_BUCKET}={b}" for b, name in names.items()})


def commit(staged: Staged, source: str | None = None, batch: int | None = None) -> int:
    """Make staged updates the newest version; `versions.Conflict` if another writer was first."""
    return versions.commit(staged.spark, staged.path, staged.base, staged.content, source, batch)


def write_registry(updates: DataFrame, path: str, doc_id: str = "doc_id", buckets: int = BUCKETS) -> int:
    """Apply updates as a new version; readers of the old one are not disturbed."""
    return commit(stage(updates, path, doc_id, buckets))
