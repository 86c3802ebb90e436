"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A temporary folder stands in only where everything runs in one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textguard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, *by: str) -> DataFrame:
    """The rows of `df`, computed once and read back from the shared folder; in a folder
    for each value of the columns `by`, so that a filter on them reads its own rows only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textguard/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for streaming sinks and their checkpoints."""
    return f"{shared_folder(spark)}/textguard/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer parts than there are cores.

    For costly per-row work on a small table in one file; a large table has more
    parts than cores and is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
