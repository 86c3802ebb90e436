"""Document corpora: registry, verification, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions.hashing import sign, text_hash, vector_hash
from textguard.operators.baseline import vector_anomalies

UNREGISTERED = "not registered"
CONTENT_MISMATCH = "content hash mismatch"
VECTOR_MISMATCH = "vector hash mismatch"
ANOMALOUS = "anomalous vector"


def text_hashes(docs: DataFrame, content: str = "text") -> DataFrame:
    """The rows with `content_hash` instead of their texts, for a join (with vectors, say) that is not to
    shuffle texts; the functions below take such rows with `content=None`."""
    return docs.select(*[c for c in docs.columns if c != content], text_hash(F.col(content)).alias("content_hash"))


def document_hashes(docs: DataFrame, content: str | None = "text", embedding: str | None = None) -> DataFrame:
    """`doc_id` and the hashes; texts stay behind, so later shuffles are narrow."""
    if content is not None:
        docs = text_hashes(docs, content)
    vector = vector_hash(F.col(embedding)) if embedding else F.lit(None).cast("string")
    kept = [c for c in docs.columns if c not in ("content_hash", embedding)]
    return docs.select(*kept, "content_hash", vector.alias("vector_hash"))


def latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row per key by (ts, content hash), by aggregation: copies of a
    key meet as partial results, however many there are."""
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(F.col(ts), F.col("content_hash")))
    return rows.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def register_documents(docs: DataFrame, keys: DataFrame, ts: str, key_id: str, content: str | None = "text",
                       embedding: str | None = None, baseline: DataFrame | None = None,
                       threshold: float | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Registry rows: hashes, signatures, anomaly score; one per document, the
    last written wins.  `keys` is a table of `hashing.signing_keys`."""
    columns = [doc_id, content or "content_hash", ts, *([embedding] if embedding else [])]
    rows = docs.select(*columns)
    if embedding and baseline is not None:
        rows = vector_anomalies(rows, baseline, embedding, threshold)
    else:
        rows = rows.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})
    newest = latest(document_hashes(rows, content, embedding), doc_id, ts)
    # Not a bare literal: the optimizer would turn the join with the keys into a nested loop.
    keyed = newest.withColumn("key_id", F.when(F.col(doc_id).isNotNull(), F.lit(key_id)))
    signed = sign(keyed, keys, {"content_sig": "content_hash", "vector_sig": "vector_hash"})
    return signed.select(
        doc_id, "content_hash", "vector_hash", "content_sig", "vector_sig", "key_id",
        F.col(ts).alias("last_verified"), F.lit(True).alias("is_valid"), "anomaly_score",
        F.col("is_anomaly").alias("tampering_detected"))


def upsert(registry: DataFrame, updates: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The registry with `updates` applied, the later `last_verified` winning."""
    return latest(registry.unionByName(updates), doc_id, "last_verified")


def verify_documents(docs: DataFrame, registry: DataFrame, content: str | None = "text", embedding: str | None = None,
                     baseline: DataFrame | None = None, threshold: float | None = None,
                     doc_id: str = "doc_id") -> DataFrame:
    """Add `is_valid` and the first `reason` against it: unregistered, content
    changed, vector changed, vector anomalous (the latter two only for documents
    that bring a vector)."""
    rows = docs
    if embedding and baseline is not None:
        rows = vector_anomalies(rows, baseline, embedding, threshold)
    else:
        rows = rows.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})
    hashed = document_hashes(rows, content, embedding)
    known = registry.select(
        F.col(doc_id).alias("_id"), F.col("content_hash").alias("_content"), F.col("vector_hash").alias("_vector"),
        F.col("tampering_detected").alias("was_anomalous"))
    joined = hashed.join(known, F.col(doc_id) == F.col("_id"), "left")
    reason = (
        F.when(F.col("_id").isNull(), F.lit(UNREGISTERED))
        .when(F.col("content_hash") != F.col("_content"), F.lit(CONTENT_MISMATCH))
        .when(F.col("vector_hash").isNotNull() & ~F.col("vector_hash").eqNullSafe(F.col("_vector")),
              F.lit(VECTOR_MISMATCH))
        .when(F.col("vector_hash").isNotNull() & F.col("is_anomaly"), F.lit(ANOMALOUS)))
    return (joined.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())
            .drop("_id", "_content", "_vector"))


def unregistered(docs: DataFrame, registry: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents the registry does not know: new ones, for registration to accept."""
    return docs.join(registry.select(doc_id), doc_id, "left_anti")


def missing(registry: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Registered documents that are no longer stored."""
    return registry.join(docs.select(doc_id), doc_id, "left_anti")


def reverification_due(last_verified: Column, now: Column, interval: int = rules.SCAN_INTERVAL) -> Column:
    """Whether the last check is more than `interval` seconds old."""
    return F.unix_seconds(now) - F.unix_seconds(last_verified) > interval


def scan_due(last_scan: float, now: float, force: bool = False, interval: int = rules.SCAN_INTERVAL) -> bool:
    return force or now - last_scan >= interval


def integrity_scan(docs: DataFrame, registry: DataFrame, content: str | None = "text", embedding: str | None = None,
                   baseline: DataFrame | None = None, threshold: float | None = None,
                   doc_id: str = "doc_id", last_scan: float = 0.0, now: float | None = None,
                   force: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """A scan of all registered documents: one row of counts, and the documents
    that failed with their reasons (a table, since they can be many).

    None if the last scan is too recent.  Documents that are gone count as
    failed, documents nobody registered are left out."""
    if now is not None and not scan_due(last_scan, now, force):
        return None
    checked = verify_documents(docs, registry, content, embedding, baseline, threshold, doc_id)
    gone = missing(registry, docs, doc_id).select(
        doc_id, F.lit(False).alias("is_valid"), F.lit("missing").alias("reason"),
        F.col("tampering_detected").alias("was_anomalous"))
    results = checked.where(F.col("reason").isNull() | (F.col("reason") != UNREGISTERED)).select(
        doc_id, "is_valid", "reason", "was_anomalous").unionByName(gone)
    summary = results.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if("is_valid").alias("verified_count"),
        F.count_if(~F.col("is_valid")).alias("tampered_count"),
        F.count_if("was_anomalous").alias("anomalous_count"))
    return summary, results.where(~F.col("is_valid")).select(doc_id, "reason")
