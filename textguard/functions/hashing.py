"""Hashes and signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_BLOCK = 64


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def vector_hash(vector: Column) -> Column:
    """Hash of a vector rounded to six decimals, the same for FLOAT and DOUBLE input."""
    millionths = F.transform(vector, lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string"))
    return F.sha2(F.array_join(millionths, ","), 256)


def signing_keys(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    """A table of HMAC keys by id, holding the two padded blocks of each key.

    Keys are data, not literals, so they never show in a query plan, the web UI
    or an event log; and several of them can be valid at a time (rotation).
    """
    rows = []
    for key_id, key in keys.items():
        block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
        rows.append((key_id, bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block)))
    return spark.createDataFrame(rows, "key_id string, inner_pad binary, outer_pad binary")


def hmac_sha256(message: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """HMAC-SHA-256 as hex digits, by its definition."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def sign(df: DataFrame, keys: DataFrame, columns: dict[str, str], key_id: str = "key_id") -> DataFrame:
    """Add a signature column per `columns` entry (new column -> hash column).

    Rows name their key in `key_id`; an unknown key gives null signatures."""
    named = keys.withColumnRenamed("key_id", "_key")
    joined = df.join(named, F.col(key_id) == F.col("_key"), "left")
    signed = joined.withColumns({
        new: hmac_sha256(F.col(old), F.col("inner_pad"), F.col("outer_pad")) for new, old in columns.items()})
    return signed.drop("_key", "inner_pad", "outer_pad")


def verify(df: DataFrame, keys: DataFrame, message: str, signature: str, result: str = "signature_valid",
           key_id: str = "key_id") -> DataFrame:
    """Add whether `signature` is the one for `message`; false without key or signature."""
    signed = sign(df, keys, {"_expected": message}, key_id)
    return signed.withColumn(
        result, F.coalesce(F.col("_expected") == F.col(signature), F.lit(False))).drop("_expected")
