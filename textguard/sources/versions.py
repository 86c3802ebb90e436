"""Versions of a table as small entries in a log, written after the data they name.

A writer stores its data where nobody looks yet, then enters its intent to make version
n + 1 of version n, reads the log, and commits only if nobody else means to or did. An
intent is written before the log is read, so of two writers at least one sees the other:
one version has one writer at most, and who comes second (or both, if they meet) gets a
`Conflict` and may start again from the newest version. Intents older than `LEASE` seconds
are those of writers that died. Every entry has a folder of its own, so that writers do
not share a temporary folder. Storage must show a file once its write has ended.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds a writer has between its intent and its commit.
LEASE = 600.0
_ENTRY = "version long, writer string, at double, kind string, source string, batch long, content map<string, string>"


class Conflict(RuntimeError):
    """Another writer makes, or has made, the same version."""


@dataclass(frozen=True)
class Version:
    """`content` names the folders the version's rows lie in, by part."""

    number: int
    content: dict[str, str]


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").json(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def _enter(spark: SparkSession, path: str, version: int, writer: str, kind: str, source: str | None = None,
           batch: int | None = None, content: dict | None = None) -> None:
    row = (version, writer, time.time(), kind, source, batch, content)
    spark.createDataFrame([row], _ENTRY).coalesce(1).write.json(f"{path}/log/{version:012d}-{kind}-{writer}")


def newest(spark: SparkSession, path: str) -> Version | None:
    """The last committed version, or None."""
    row = _log(spark, path).where("kind = 'commit'").orderBy(F.desc("version")).limit(1).collect()
    return Version(row[0].version, row[0].content) if row else None


def committed(spark: SparkSession, path: str, source: str, batch: int) -> bool:
    """Whether a source's batch has become part of a version."""
    same = (F.col("source") == source) & (F.col("batch") >= batch)
    return not _log(spark, path).where((F.col("kind") == "commit") & same).isEmpty()


def commit(spark: SparkSession, path: str, base: int, content: dict[str, str], source: str | None = None,
           batch: int | None = None, lease: float = LEASE) -> int:
    """Make version `base + 1`; `Conflict` if another writer is or was there."""
    writer, version, start = uuid.uuid4().hex, base + 1, time.time()
    _enter(spark, path, version, writer, "intent")
    others = _log(spark, path).where((F.col("version") >= version) & (F.col("writer") != writer))
    rivals = others.where((F.col("kind") == "commit") | ((F.col("kind") == "intent") & (F.col("at") > start - lease)))
    # A rival that saw this intent has withdrawn, and says so.
    gone = others.where("kind = 'withdrawn'").select("writer")
    if not rivals.join(gone, "writer", "left_anti").isEmpty() or time.time() - start > lease:
        _enter(spark, path, version, writer, "withdrawn")
        raise Conflict(f"version {version} of {path} has another writer")
    _enter(spark, path, version, writer, "commit", source, batch, content)
    return version


def read(spark: SparkSession, path: str, parts: list[str] | None = None) -> tuple[int, DataFrame | None]:
    """Number and rows of the newest version (0 and None if there is none), of some parts only if asked."""
    known = newest(spark, path)
    if known is None:
        return 0, None
    folders = [folder for part, folder in known.content.items() if parts is None or part in parts]
    return known.number, spark.read.parquet(*[f"{path}/data/{f}" for f in folders]) if folders else None
