"""The guards on streams: each reads a table as a stream to its end and must give
what SQL gives for the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.agents import CALLS, CHANGE, DRIFT, SQL_TURNS, sql_alert, sql_authorized, sql_drift, tool_calls_from
from catalog.common import ATTACKS, SHORT, load, picked, planted, sql_clean, sql_nfkc, sql_planted, sql_scored, utc
from catalog.prompts import INJECTION_SCORE, SLOW_LIMITS, SQL_NUMBER, number, sql_context, sql_rate_limit, sql_turns
from textguard.durable import scratch_path
from textguard.operators.drift import drift_alerts
from textguard.operators.permissions import authorize, passing_calls, tool_scopes
from textguard.operators.ratelimit import rate_limit
from textguard.operators.sanitize import context_similarity, sanitize
from textguard.sources.audit import write_audit, write_audit_stream
from textguard.streaming import flows, stateful


SLICES = 3


def in_slices(spark, sf, table, time, build, name, last=None):
    """What `build` makes of a stream of the table, which arrives in slices of time: each is written
    and the stream run on to its end, so that every run after the first starts from stored state.
    `last`, a function of the table, gives rows that come at the very end."""
    rows = load(spark, sf, table)
    cuts = rows.select(time.cast("double").alias("t")).agg(
        F.percentile_approx("t", [k / SLICES for k in range(1, SLICES)], 10_000)).first()[0]
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < time.cast("double")))
    slices = [rows.where(part == k) for k in range(SLICES)] + ([last(rows)] if last else [])
    source, out, checkpoint = (scratch_path(spark, f"{name}-{k}") for k in ("source", "out", "checkpoint"))
    for some in slices:
        some.write.mode("append").parquet(source)
        result = build(spark.readStream.schema(rows.schema).parquet(source))
        flows.append_to(result, out, checkpoint).awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def event_time():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def from_events(spark, sf, build, name):
    utc(spark)
    stateful.use_rocksdb(spark)
    return in_slices(spark, sf, "events", event_time(), lambda e: build(
        e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")), name)


def stream_rate_limit(spark, sf):
    return from_events(spark, sf, lambda e: stateful.rate_limit_stream(
        e, "user_id", "ts", "event_id", SLOW_LIMITS), "rate-limit").select("user_id", "event_id", "allowed")


STREAM_RATE_LIMIT = f"""SELECT user_id, event_id, allowed FROM (
{sql_rate_limit("(SELECT *, epoch_us(ts) AS us FROM events)", SLOW_LIMITS)})"""


def stream_retrieval_counts(spark, sf):
    """Windows come out once the watermark has passed them. At the end come rows that are too late
    to count, and one far ahead (of no user), which closes all other windows."""
    utc(spark)

    def last(rows):
        ends = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        late = rows.where(F.col("event_id") % 10 == 0).crossJoin(F.broadcast(ends)).select(
            *[F.col("first").alias("ts") if c == "ts" else F.col(c) for c in rows.columns])
        ahead = ends.select(*[
            (F.col("last") + F.expr("INTERVAL 1 DAY")).cast(kind).alias(c) if c == "ts" else F.lit(None).cast(kind).alias(c)
            for c, kind in rows.dtypes])
        return late.unionByName(ahead)

    counts = in_slices(spark, sf, "events", event_time(), lambda e: flows.retrieval_counts_stream(
        e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600, "2 hours"), "retrieval-counts", last)
    return counts.select("user_id", F.unix_seconds("window_start").alias("window_start"), "retrieval_count")


STREAM_RETRIEVAL_COUNTS = """
SELECT user_id, (epoch_us(ts) // 3600000000) * 3600 AS window_start, count(*) AS retrieval_count FROM events
GROUP BY 1, 2"""


def stream_sanitize(spark, sf):
    """A guard that looks at one row at a time runs on a stream as it is."""
    c = flows.read_stream(spark, sf, "conversations.parquet")
    c = c.withColumn("prompt", planted(F.col("text"), ATTACKS, number()))
    r = F.col("sanitization_result")
    clean = sanitize(c).select("conv_id", "turn", r["injection_score"].alias("injection_score"),
                               F.array_join(r["matched_categories"], ",").alias("categories"), (~r["is_safe"]).alias("is_injection"))
    return flows.drain(clean, "sanitize")


def stream_drift(spark, sf):
    stateful.use_rocksdb(spark)

    def build(e):
        turns = e.select("vec_id", "embedding", F.pmod("vec_id", F.lit(25)).alias("user_id"),
                         F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 60).alias("ts")).withWatermark("ts", "1 hour")
        return stateful.drift_stream(turns, "user_id", "ts", "vec_id", "embedding", DRIFT, CHANGE)

    return drift_columns(in_slices(spark, sf, "embeddings", F.col("vec_id"), build, "drift"))


def drift_columns(tracked):
    return tracked.select("user_id", "vec_id", *[F.round(c, 6).alias(c) for c in (
        "similarity", "drift", "change_rate", "max_drift", "max_change_rate")], "is_suspicious", "reason")


STREAM_DRIFT = f"""
SELECT user_id, vec_id, round(similarity, 6) AS similarity, round(drift, 6) AS drift, round(change_rate, 6) AS change_rate,
       round(max_drift, 6) AS max_drift, round(max_change_rate, 6) AS max_change_rate,
       {sql_alert()} IS NOT NULL AS is_suspicious, {sql_alert()} AS reason
FROM ({sql_drift("(SELECT vec_id % 25 AS user_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings)", 'user_id', 'vec_id')})"""


def stream_usage_caps(spark, sf):
    """Calls that pass all other checks, against the caps."""
    def build(e):
        passing = passing_calls(tool_calls_from(e), tool_scopes(spark))
        return stateful.usage_cap_stream(passing, "user_id", "tool_name", "ts", "call_id", "max_uses")

    return from_events(spark, sf, build, "usage-caps").select("user_id", "tool_name", "call_id", "is_allowed")


STREAM_USAGE_CAPS = f"SELECT user_id, tool_name, call_id, is_allowed FROM {sql_authorized(CALLS)} WHERE known AND passes"


def stream_context(spark, sf):
    utc(spark)
    stateful.use_rocksdb(spark)
    seconds = F.col("turn") * 60 + F.floor(F.col("turn") / 3) * 240

    def build(c):
        c = (c.withColumn("text", planted(F.col("text"), ATTACKS, number())).withColumn("request_id", number())
             .withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + seconds)).withWatermark("ts", "1 hour"))
        return stateful.context_stream(c, "conv_id", "ts", "request_id", "text")

    return in_slices(spark, sf, "conversations", F.col("turn"), build, "context").select("conv_id", "request_id", F.round("context_score", 6).alias("context_score"))


STREAM_CONTEXT = f"""SELECT conv_id, conv_id * 8 + turn AS request_id, round(context_score, 6) AS context_score
FROM ({sql_context('text', sql_turns(ATTACKS))})"""

def stream_audit(spark, sf):
    """Audit records of a stream of screened turns; the first micro-batch is then written once more, as
    after a failure, and leaves no second copy."""
    utc(spark)

    def records(c):
        c = c.withColumn("prompt", planted(F.col("text"), ATTACKS, number()))
        return sanitize(c.withColumn("raw_prompt", F.col("prompt"))).select(
            number().alias("request_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 600).alias("ts"),
            F.col("conv_id").cast("string").alias("user_id"), "prompt", "raw_prompt", (~F.col("sanitization_result.is_safe")).alias("is_blocked"),
            F.col("sanitization_result.reason").alias("reason"), F.lit("").alias("response"))

    rows = load(spark, sf, "conversations")
    source, out, checkpoint = (scratch_path(spark, f"audit-{k}") for k in ("source", "out", "checkpoint"))
    slices = [rows.where(F.pmod("conv_id", F.lit(SLICES)) == k) for k in range(SLICES)]
    for some in slices:
        some.write.mode("append").parquet(source)
        live = records(spark.readStream.schema(rows.schema).parquet(source))
        write_audit_stream(live, out, checkpoint).awaitTermination()
    write_audit(records(slices[0]), out, source="stream", batch=0)
    return spark.read.parquet(out).select("request_id", F.col("date").cast("string").alias("date"), "prompt_hash", "is_blocked")


_SPOKEN = f"(SELECT conv_id, turn, {sql_planted('text', ATTACKS, SQL_NUMBER)} AS raw FROM conversations)"
_CLEAN = f"(SELECT *, {sql_clean(sql_nfkc('raw'))} AS prompt FROM {_SPOKEN})"
STREAM_AUDIT = f"""
SELECT {SQL_NUMBER} AS request_id, strftime(make_timestamp((1700000000 + conv_id * 600) * 1000000), '%Y-%m-%d') AS date,
       sha256(raw) AS prompt_hash, injection_score >= 2.0 AS is_blocked
FROM {_CLEAN} JOIN ({sql_scored(_CLEAN, 'conv_id, turn', 'prompt')}) USING (conv_id, turn)"""


def from_history(spark, sf, table, time, decide, build, name):
    """What `build` (of a stream and a history) gives for a table of which the first half is history: rows
    that `decide`, a batch operator, has dealt with before, whose last state per key the stream starts
    from; the other half arrives in two slices. The history's own results are put in front."""
    rows = load(spark, sf, table)
    cuts = rows.select(time.cast("double").alias("t")).agg(F.percentile_approx("t", [0.5, 0.75], 10_000)).first()[0]
    earlier = rows.where(time.cast("double") <= cuts[0])
    slices = [rows.where((time.cast("double") > cuts[0]) & (time.cast("double") <= cuts[1])), rows.where(time.cast("double") > cuts[1])]
    source, out, checkpoint = (scratch_path(spark, f"{name}-{k}") for k in ("source", "out", "checkpoint"))
    for some in slices:
        some.write.mode("append").parquet(source)
        result = build(spark.readStream.schema(rows.schema).parquet(source), earlier)
        flows.append_to(result, out, checkpoint).awaitTermination()
    return decide(earlier).unionByName(spark.read.schema(result.schema).parquet(out))


def stamped(e):
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def history_rate_limit(spark, sf):
    utc(spark)
    stateful.use_rocksdb(spark)
    return from_history(
        spark, sf, "events", event_time(),
        lambda h: rate_limit(stamped(h), "user_id", "ts", "event_id", SLOW_LIMITS).select("user_id", "event_id", "allowed"),
        lambda e, h: stateful.rate_limit_stream(
            stamped(e).withWatermark("ts", "1 hour"), "user_id", "ts", "event_id", SLOW_LIMITS, stamped(h)).select("user_id", "event_id", "allowed"),
        "history-rate-limit")


def history_drift(spark, sf):
    """Some turns are short answers, which the stream leaves out of the conversation as the batch does."""
    stateful.use_rocksdb(spark)

    def turns(e):
        return e.select("vec_id", "embedding", F.pmod("vec_id", F.lit(25)).alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 60).alias("ts"),
                        picked((*SHORT, *["a longer question here"] * 15), F.col("vec_id") * 7).alias("text"))

    def decide(h):
        r = F.col("context_tracking")
        found = drift_alerts(turns(h), "user_id", "ts", "vec_id", "text", drift_threshold=DRIFT, change_threshold=CHANGE)
        return drift_columns(found.select("user_id", "vec_id", *[r[c].alias(c) for c in (
            "similarity", "drift", "change_rate", "max_drift", "max_change_rate", "is_suspicious", "reason")]))

    def build(e, h):
        return drift_columns(stateful.drift_stream(
            turns(e).withWatermark("ts", "1 hour"), "user_id", "ts", "vec_id", "embedding", DRIFT, CHANGE, text="text", history=turns(h)))

    return from_history(spark, sf, "embeddings", F.col("vec_id"), decide, build, "history-drift")


HISTORY_DRIFT = f"""
SELECT user_id, vec_id, round(similarity, 6) AS similarity, round(drift, 6) AS drift, round(change_rate, 6) AS change_rate,
       round(max_drift, 6) AS max_drift, round(max_change_rate, 6) AS max_change_rate,
       {sql_alert()} IS NOT NULL AS is_suspicious, {sql_alert()} AS reason
FROM (SELECT * FROM ({sql_drift(f"(SELECT * FROM {SQL_TURNS} WHERE NOT trivial)", 'user_id', 'vec_id')})
      UNION ALL SELECT user_id, vec_id, 1.0, 0.0, 0.0, NULL, NULL FROM {SQL_TURNS} WHERE trivial)"""


def history_usage_caps(spark, sf):
    utc(spark)
    stateful.use_rocksdb(spark)

    def decided(h):
        calls = tool_calls_from(stamped(h))
        passing = passing_calls(calls, tool_scopes(spark))
        allowed = authorize(calls, tool_scopes(spark), row_id="call_id").select("call_id", "is_allowed")
        return passing.join(allowed, "call_id")

    columns = ("user_id", "tool_name", "call_id", "is_allowed")
    return from_history(
        spark, sf, "events", event_time(), lambda h: decided(h).select(*columns),
        lambda e, h: stateful.usage_cap_stream(
            passing_calls(tool_calls_from(stamped(e).withWatermark("ts", "1 hour")), tool_scopes(spark)),
            "user_id", "tool_name", "ts", "call_id", "max_uses", history=decided(h)).select(*columns), "history-usage-caps")


def history_context(spark, sf):
    utc(spark)
    stateful.use_rocksdb(spark)
    seconds = F.col("turn") * 60 + F.floor(F.col("turn") / 3) * 240

    def requests(c):
        return c.withColumn("text", planted(F.col("text"), ATTACKS, number())).withColumn("request_id", number()).withColumn(
            "ts", F.timestamp_seconds(F.lit(1_700_000_000) + seconds))

    def columns(found):
        return found.select("conv_id", "request_id", F.round("context_score", 6).alias("context_score"))

    return from_history(
        spark, sf, "conversations", F.col("turn"),
        lambda h: columns(context_similarity(requests(h), "conv_id", "ts", "request_id", "text")),
        lambda c, h: columns(stateful.context_stream(
            requests(c).withWatermark("ts", "1 hour"), "conv_id", "ts", "request_id", "text", history=requests(h))), "history-context")


QUERIES = {
    "stream_audit": (stream_audit, STREAM_AUDIT),
    "history_rate_limit": (history_rate_limit, STREAM_RATE_LIMIT),
    "history_drift": (history_drift, HISTORY_DRIFT),
    "history_usage_caps": (history_usage_caps, STREAM_USAGE_CAPS),
    "history_context": (history_context, STREAM_CONTEXT),
    "stream_rate_limit": (stream_rate_limit, STREAM_RATE_LIMIT),
    "stream_retrieval_counts": (stream_retrieval_counts, STREAM_RETRIEVAL_COUNTS),
    "stream_sanitize": (stream_sanitize, INJECTION_SCORE),
    "stream_drift": (stream_drift, STREAM_DRIFT),
    "stream_usage_caps": (stream_usage_caps, STREAM_USAGE_CAPS),
    "stream_context": (stream_context, STREAM_CONTEXT),
}
