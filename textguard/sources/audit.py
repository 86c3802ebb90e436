"""Writing audit records and reports."""

from __future__ import annotations

import time
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textguard import rules


def audit_records(verdicts: DataFrame, keep_prompts: bool = False) -> DataFrame:
    """One record per request: verdict, reason and all guard results.

    The prompt as sent is stored as its hash unless `keep_prompts`; the answer is
    the one given to the user, hence redacted.  Without `keep_prompts` the results
    lose their copy of the prompt as well, and the personal data they found."""
    original = "raw_prompt" if "raw_prompt" in verdicts.columns else "prompt"
    prompt = F.col(original) if keep_prompts else F.sha2(original, 256)
    name = "prompt" if keep_prompts else "prompt_hash"
    results = [c for c in (
        "sanitization_result", "enforcement_result", "context_tracking",
        "retrieval_analysis", "integrity_check", "filter_result") if c in verdicts.columns]
    if not keep_prompts:
        if "sanitization_result" in results:
            verdicts = verdicts.withColumn(
                "sanitization_result", F.col("sanitization_result").dropFields("sanitized_text"))
        if "filter_result" in results:
            bare = F.transform("filter_result.detected_entities", lambda e: e.dropFields("text"))
            verdicts = verdicts.withColumn(
                "filter_result", F.col("filter_result").withField("detected_entities", bare))
    return verdicts.select(
        F.to_date("ts").alias("date"), "request_id", "ts", "user_id", prompt.alias(name),
        "is_blocked", "reason", "response", *results)


def write_once(df: DataFrame, path: str, source: str, batch: int, by: tuple[str, ...] = ()) -> None:
    """Write a source's batch to a folder of its own, in place of what an earlier attempt left there:
    a repeated batch leaves no second copy. Reading `path` gives all batches, with both as columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/source={quote(source, safe='')}/batch={int(batch)}")


def write_audit(verdicts: DataFrame, path: str, keep_prompts: bool = False, source: str = "batch",
                batch: int | None = None) -> None:
    """Write the records of a batch, one folder per day.

    With a number, the batch is written once however often it is repeated; without one,
    it is new each time."""
    records = audit_records(verdicts, keep_prompts)
    write_once(records, path, source, time.time_ns() if batch is None else batch, ("date",))


def write_audit_stream(verdicts: DataFrame, path: str, checkpoint: str, keep_prompts: bool = False,
                       source: str = "stream", **trigger) -> StreamingQuery:
    """Write the records of a stream, each micro-batch once: if it is repeated after a failure, it
    takes the place of its first attempt."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_once(batch, path, source, batch_id, ("date",))

    return (
        audit_records(verdicts, keep_prompts).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start())


def security_events(verdicts: DataFrame) -> DataFrame:
    """The events behind the verdicts: request, user, event type and details.

    A request can raise several; each guard result present adds its own."""
    def event(kind: str, when: Column, details: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("event_type"), F.to_json(details).alias("details")))

    events = []
    if "sanitization_result" in verdicts.columns:
        r = F.col("sanitization_result")
        events.append(event("early_exit_triggered", r["exit_probability"] > rules.EXIT_TRIGGER, F.struct(
            r["exit_probability"].alias("exit_probability"))))
    if "context_tracking" in verdicts.columns:
        r = F.col("context_tracking")
        events.append(event("context_manipulation_detected", r["is_suspicious"], F.struct(
            r["reason"].alias("reason"), r["max_drift"].alias("drift"),
            r["max_change_rate"].alias("change_rate"))))
    if "enforcement_result" in verdicts.columns:
        r = F.col("enforcement_result")
        events.append(event("permission_denied", ~r["is_allowed"], F.struct(r["reason"].alias("reason"))))
    if "filter_result" in verdicts.columns:
        r = F.col("filter_result")
        events.append(event("unsafe_content_detected", ~r["is_safe"], F.struct(
            F.size(r["detected_entities"]).alias("entities"), r["policy_violations"].alias("violations"),
            r["toxicity_score"].alias("toxicity"))))
    return (
        verdicts.select("request_id", "ts", "user_id", F.explode(F.array_compact(F.array(*events))).alias("_e"))
        .select("request_id", "ts", "user_id", "_e.event_type", "_e.details"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, in place of an older one."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
