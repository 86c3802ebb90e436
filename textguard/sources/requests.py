"""Reading requests and labelled texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import rules



def requests_from(df: DataFrame, request_id: str, ts: str, user: str, prompt: str,
                  extra: Sequence[str] = ()) -> DataFrame:
    """Requests in the common shape, with defaults for the security context.

    `extra` columns are carried along.  Columns named permissions, risk_level
    and embedding are used where `df` has them."""
    def column(name: str, kind: str, default: Column) -> Column:
        given = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.coalesce(given, default).alias(name)

    vector = F.col("embedding") if "embedding" in df.columns else F.lit(None).cast("array<float>")
    return df.select(
        F.col(request_id).alias("request_id"),
        F.col(ts).alias("ts"),
        F.coalesce(F.col(user).cast("string"), F.lit("anonymous")).alias("user_id"),
        F.col(prompt).alias("prompt"),
        F.col(prompt).alias("text"),
        vector.alias("embedding"),
        column("permissions", "array<string>", F.array().cast("array<string>")),
        column("risk_level", "double", F.lit(0.0)),
        *extra,
    )


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns filled, and the others with the names of
    what they lack in `missing`."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    marked = df.withColumn("missing", missing)
    return (marked.where(F.size("missing") == 0).drop("missing"),
            marked.where(F.size("missing") > 0))


def load_labelled(spark: SparkSession, texts: str, labels: str, key: str = "doc_id",
                  label: str = "toxic") -> DataFrame:
    """Texts with a 0/1 label, from two Parquet tables sharing a key."""
    left = spark.read.parquet(texts)
    right = spark.read.parquet(labels).select(key, F.col(label).cast("int").alias("label"))
    return left.join(right, key)


def assign_users(df: DataFrame, row_number: str, users: int = rules.REPLAY_USERS,
                 prefix: str = "benchmark_user_") -> DataFrame:
    """Spread numbered rows over a rotating set of user names."""
    return df.withColumn("user_id", F.concat(
        F.lit(prefix), F.pmod(F.col(row_number), F.lit(users)).cast("string")))
