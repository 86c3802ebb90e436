"""Streams over several micro-batches must give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from textguard.operators import retrieval as ret
from textguard.operators.baseline import vector_moments
from textguard.operators.drift import conversation_drift
from textguard.operators.integrity import latest
from textguard.operators.ratelimit import rate_limit
from textguard.operators.sanitize import context_similarity, sanitize
from textguard.sources import versions
from textguard.sources.audit import write_audit_stream
from textguard.streaming import flows, stateful

SLOW = (("burst", 3.0, 1 / 21600), ("sustained", 10.0, 1 / 86400))


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The events in three files, in order of time; each file is a micro-batch."""
    stateful.use_rocksdb(spark)
    path = tmp_path_factory.mktemp("events")
    events = small("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("user_id", F.col("user_id") % 5)
    for part in range(3):
        events.where((F.col("event_id") >= part * 334) & (F.col("event_id") < (part + 1) * 334)).coalesce(1).write.mode(
            "append").parquet(str(path))
    return str(path)


def stream(spark, folder):
    return flows.read_stream(spark, folder, files_per_trigger=1)


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_rate_limit(spark, folder):
    out = flows.drain(stateful.rate_limit_stream(
        stream(spark, folder).withWatermark("ts", "1 hour"), "user_id", "ts", "event_id", SLOW), "t")
    batch = rate_limit(spark.read.parquet(folder), "user_id", "ts", "event_id", SLOW)
    assert rows(out, "event_id", "allowed") == rows(batch, "event_id", "allowed")
    assert {r.allowed for r in out.collect()} == {True, False}


def test_context(spark, folder):
    spoken = F.concat_ws(" ", "event_type", F.pmod("event_id", F.lit(3)).cast("string"))
    out = flows.drain(stateful.context_stream(
        stream(spark, folder).withColumn("t", spoken).withWatermark("ts", "1 hour"), "user_id", "ts", "event_id", "t", 40_000), "t")
    batch = context_similarity(spark.read.parquet(folder).withColumn("t", spoken), "user_id", "ts", "event_id", "t", 40_000)
    assert rows(out, "event_id", "context_score") == rows(batch, "event_id", "context_score")
    assert out.where("context_score > 0").count() > 100


def test_drift(spark, folder):
    vector = F.array(F.col("value"), F.col("value") * 0 + F.pmod("event_id", F.lit(7)) - 3)
    live = stream(spark, folder).withWatermark("ts", "1 hour").withColumn("embedding", vector)
    out = flows.drain(stateful.drift_stream(live, "user_id", "ts", "event_id", "embedding", 1.1, 0.3), "t")
    batch = conversation_drift(spark.read.parquet(folder).withColumn("embedding", vector), "user_id", "ts", "event_id")
    names = ["event_id", "similarity", "drift", "change_rate", "max_drift", "max_change_rate"]
    assert rows(out, *names) == rows(batch, *names)
    assert out.where("is_suspicious and reason is not null").count() > 0
    cooled = flows.drain(stateful.drift_stream(live, "user_id", "ts", "event_id", "embedding", 1.1, 0.3, 1e9), "t")
    assert cooled.where("is_suspicious").count() <= 5


def test_usage_caps(spark, folder):
    capped = lambda d: d.select("user_id", "event_type", "ts", "event_id", F.lit(4).alias("cap"))
    out = flows.drain(stateful.usage_cap_stream(capped(stream(spark, folder).withWatermark("ts", "1 hour")), "user_id", "event_type", "ts", "event_id", "cap"), "t")
    per_key = {}
    for r in out.orderBy("ts", "event_id").collect():
        per_key.setdefault((r.user_id, r.event_type), []).append(r.is_allowed)
    assert all(v == [True] * min(4, len(v)) + [False] * (len(v) - 4) for v in per_key.values())


def test_usage_caps_end_with_the_session(spark, folder):
    live = stream(spark, folder).withWatermark("ts", "1 minute").select(
        "user_id", "event_type", "ts", "event_id", F.lit(2).alias("cap"))
    out = flows.drain(stateful.usage_cap_stream(
        live, "user_id", "event_type", "ts", "event_id", "cap", session_seconds=43200), "t")
    used, last, resets = {}, {}, 0
    for r in out.orderBy("ts", "event_id").collect():
        key = (r.user_id, r.event_type)
        if key in last and (r.ts - last[key]).total_seconds() > 43200:
            used[key], resets = 0, resets + 1
        assert r.is_allowed == (used.get(key, 0) < 2)
        used[key], last[key] = used.get(key, 0) + r.is_allowed, r.ts
    assert resets > 10


def few_states(out, checkpoint, df):
    """The rows that a stream wrote, and how many values of state it holds."""
    query = flows.append_to(df, out, checkpoint)
    query.awaitTermination()
    return df.sparkSession.read.parquet(out), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_many_keys_share_calls_and_states(spark, folder, tmp_path):
    """500 keys with two rows each are eight groups, and give what they give one by one, null keys and times included."""
    keyed = lambda d: d.withColumn("k", F.when(F.col("event_id") % 500 > 0, F.col("event_id") % 500)).withColumn(
        "ts", F.when(F.col("event_id") != 7, F.col("ts")))
    live, whole = keyed(stream(spark, folder)).withWatermark("ts", "100 days"), keyed(spark.read.parquet(folder))
    once = (("burst", 1.0, 1 / 8640000),)
    out, n = few_states(str(tmp_path / "a"), str(tmp_path / "b"), stateful.rate_limit_stream(live, "k", "ts", "event_id", once, groups=8))
    want = rows(rate_limit(whole.where("event_id % 500 != 7"), "k", "ts", "event_id", once), "event_id", "allowed")
    assert rows(out.where("event_id % 500 != 7"), "event_id", "allowed") == want and out.count() == 1000
    assert n <= 3 * 8, "a group's states, its timer, and that by time"
    capped = live.select("k", "event_type", "ts", "event_id", F.lit(1).alias("cap"))
    out, n = few_states(str(tmp_path / "c"), str(tmp_path / "d"), stateful.usage_cap_stream(
        capped, "k", "event_type", "ts", "event_id", "cap", groups=8))
    timed = whole.where("event_id % 500 != 7")
    assert out.where("is_allowed and event_id % 500 != 7").count() == timed.select("k", "event_type").distinct().count()
    assert out.count() == 1000
    assert n <= 3 * 8


def test_keys_of_a_group_keep_their_own_states(spark, tmp_path):
    """Two keys in one group, from a history on and over runs: each has its own count and session."""
    def run(past, moments):
        for k, (key, s) in enumerate(moments):
            spark.createDataFrame([(key, k, s)], "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(
                1).write.mode("append").parquet(str(tmp_path / "in"))
        live = flows.read_stream(spark, str(tmp_path / "in")).withWatermark("ts", "1 second")
        calls = live.select("k", F.lit("t").alias("tool"), "ts", "id", F.lit(2).alias("cap"))
        return few_states(str(tmp_path / "out"), str(tmp_path / "cp"), stateful.usage_cap_stream(
            calls, "k", "tool", "ts", "id", "cap", session_seconds=100, history=past, groups=1))[0]

    past = spark.createDataFrame([("a", "t", 900, 1, True), ("b", "t", 1000, 2, True), ("b", "t", 1001, 3, True)],
                                 "k string, tool string, s long, id long, is_allowed boolean").withColumn("ts", F.timestamp_seconds("s"))
    stateful.use_rocksdb(spark)
    run(past, [("a", 1050), ("b", 1051)])
    run(past, [("a", 1150), ("b", 1151), ("a", 1149)])
    out = run(past, [("a", 1251), ("b", 1251)])
    assert sorted((r.k, r.ts.timestamp(), r.is_allowed) for r in out.collect()) == [
        ("a", 1050.0, True), ("a", 1149.0, True), ("a", 1150.0, False), ("a", 1251.0, True),
        ("b", 1051.0, False), ("b", 1151.0, False), ("b", 1251.0, False)]


def test_windows_and_late_rows(spark, folder):
    out = flows.drain(flows.retrieval_counts_stream(stream(spark, folder), "user_id", "ts", 3600, "1 hour"), "t")
    batch = ret.retrieval_counts(spark.read.parquet(folder), "user_id", "ts", 3600)
    last = spark.read.parquet(folder).agg(F.max(F.unix_seconds("ts"))).first()[0] - 3600
    done = batch.where(F.unix_seconds("window_start") + 3600 <= last)
    assert rows(out, "user_id", "window_start", "retrieval_count") == rows(done, "user_id", "window_start", "retrieval_count")


def test_guard_and_audit_sink(spark, folder, tmp_path):
    prompt = F.when(F.col("event_id") % 3 == 0, "jailbreak").otherwise(F.col("event_type"))
    shape = lambda d: sanitize(d.withColumn("prompt", prompt)).select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("user_id"), "prompt",
        (~F.col("sanitization_result.is_safe")).alias("is_blocked"), F.col("sanitization_result.reason").alias("reason"),
        F.lit("x").alias("response"), "sanitization_result")
    query = write_audit_stream(shape(stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert rows(stored, "request_id", "is_blocked") == rows(shape(spark.read.parquet(folder)), "request_id", "is_blocked")
    again = write_audit_stream(shape(stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000, "a restart adds nothing twice"


def test_registry_stream(spark, folder, tmp_path):
    updates = lambda d: d.select(
        (F.col("event_id") % 100).alias("doc_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"),
        F.col("ts").alias("last_verified"))
    path = str(tmp_path / "registry")
    seen = lambda d: latest(updates(d), "doc_id", "last_verified")
    flows.registry_stream(updates(stream(spark, folder)), path, str(tmp_path / "cp")).awaitTermination()
    version, table = versions.read(spark, path)
    assert version == 3
    got, want = rows(table, "doc_id", "content_hash"), rows(seen(spark.read.parquet(folder)), "doc_id", "content_hash")
    assert dict(got) == dict(want) and len(got) == 100


def test_baseline_stream(spark, folder, tmp_path):
    vectors = lambda d: d.select(F.array(F.col("value"), F.col("event_id").cast("double")).alias("embedding"))
    path = str(tmp_path / "baseline")
    flows.baseline_stream(vectors(stream(spark, folder)), path, str(tmp_path / "cp")).awaitTermination()
    got = versions.read(spark, path)[1].first()
    want = vector_moments(vectors(spark.read.parquet(folder))).first()
    assert got.n == want.n == 1000
    assert all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(got.mean + got.scatter, want.mean + want.scatter))


def test_slices_bound_memory():
    """A key with a million rows in a micro-batch: slices are sorted, and little more than one is held."""
    import tracemalloc

    import pandas as pd

    def parts():
        for k in range(100):
            yield pd.DataFrame({"ts": range(10_000 * k + 9_999, 10_000 * k - 1, -1), "id": 1})

    tracemalloc.start()
    seen = 0
    for some in stateful._slicer(stateful.SLICE_ROWS)(parts(), ["ts", "id"]):
        assert len(some) < stateful.SLICE_ROWS + 10_000 and some["ts"].is_monotonic_increasing
        seen += len(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 1_000_000 and peak < 20 * 2**20


def test_history_ends_with_a_pause(spark, folder, tmp_path):
    """Turns before a long pause are not part of the conversation that goes on in the stream."""
    rows = [("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0]), ("u", 9000, [1.0, 1.0]), ("v", 5, [0.0, 2.0])]
    past = spark.createDataFrame(rows, "k string, s long, e array<double>").withColumn("ts", F.timestamp_seconds("s"))
    later = spark.createDataFrame([("u", 9001, [-1.0, -1.0]), ("u", 9002, [-1.0, 0.0]), ("w", 9003, [1.0, 0.0])], "k string, s long, e array<double>")
    later.withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    live = flows.read_stream(spark, str(tmp_path / "in")).withWatermark("ts", "1 hour")
    out = flows.drain(stateful.drift_stream(live, "k", "ts", "s", "e", alert_interval=60, idle_seconds=3600, history=past), "t")
    got = {r.s: (round(r.drift, 6), round(r.change_rate, 6), round(r.max_drift, 6), r.is_suspicious) for r in out.collect()}
    assert got == {9001: (2.0, 0.0, 2.0, True), 9002: (1.707107, 1.707107, 2.0, False), 9003: (0.0, 0.0, 0.0, False)}


@pytest.mark.parametrize("in_folder", [False, True])
def test_table_in_one_file_or_in_a_folder_of_files(spark, tmp_path, in_folder):
    table = spark.createDataFrame([(1, 0, "jailbreak"), (1, 1, None), (None, 2, "hello there")], "conv_id long, turn int, text string")
    if in_folder:
        table.repartition(2).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        table.toPandas().astype({"conv_id": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    spark.range(3).write.parquet(str(tmp_path / "others.parquet"))
    found = flows.drain(flows.read_stream(spark, str(tmp_path), "conversations.parquet"), "t")
    assert rows(found.select("turn", F.coalesce("text", F.lit("-")).alias("text")), "turn", "text") == [(0, "jailbreak"), (1, "-"), (2, "hello there")]
