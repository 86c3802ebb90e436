"""Running the guards over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textguard.durable import scratch_path
from textguard.operators.baseline import MOMENTS, merge_moments, vector_moments
from textguard.operators.retrieval import retrieval_counts
from textguard.sources import registry, versions


def read_stream(spark: SparkSession, folder: str, files: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder, in the schema they have; `files` is a pattern
    of their names, and a table that is a folder of files itself (as Spark writes it) counts, too.

    The limit of files bounds a micro-batch, and so what a key can bring at once."""
    # Braces make it a pattern: a stream takes a plain path for a folder, also where it is a file.
    path = folder if files == "*" else f"{folder}/{{{files}}}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_to(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet files; by default what is there now, then stop."""
    return (df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(path))


def drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is available and read the written result.

    The number of state partitions is fixed when a stream first starts: the
    session's number of shuffle partitions."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    append_to(df, out, scratch_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def retrieval_counts_stream(log: DataFrame, user: str, ts: str, seconds: int, lateness: str,
                            slide: int | None = None) -> DataFrame:
    """Retrievals per user and window; rows later than `lateness` are dropped."""
    return retrieval_counts(log.withWatermark(ts, lateness), user, ts, seconds, slide)


def registry_stream(updates: DataFrame, path: str, checkpoint: str, buckets: int = registry.BUCKETS, **trigger) -> StreamingQuery:
    """Keep a document registry current: each micro-batch makes a new version.

    A version remembers the stream (by its checkpoint) and the micro-batch it holds, so a
    repeated micro-batch is left out."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if not versions.committed(batch.sparkSession, path, checkpoint, batch_id):
            registry.commit(registry.stage(batch, path, buckets=buckets), checkpoint, batch_id)

    return (updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def baseline_stream(vectors: DataFrame, path: str, checkpoint: str, embedding: str = "embedding",
                    **trigger) -> StreamingQuery:
    """Keep the moments of a growing set of safe vectors, without reading old ones again."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if versions.committed(spark, path, checkpoint, batch_id):
            return
        moments = vector_moments(batch, embedding)
        number, known = versions.read(spark, path)
        if known is not None:
            moments = merge_moments(moments.unionByName(spark.createDataFrame(known.collect(), MOMENTS)))
        folder = uuid.uuid4().hex
        moments.write.parquet(f"{path}/data/{folder}")
        versions.commit(spark, path, number, {"moments": folder}, checkpoint, batch_id)

    return (vectors.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
