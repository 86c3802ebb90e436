"""Segmented computations must give what the plain windows give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textguard.operators.drift import conversation_drift, first_n, last_n
from textguard.operators.ordered import Ordered, large_keys, micros, with_segments
from textguard.operators.ratelimit import bucket_step, cooldown, rate_limit

SLOW = (("burst", 3.0, 1 / 21600), ("sustained", 10.0, 1 / 86400))


@pytest.fixture(scope="module")
def events(spark, small):
    """A third of the rows without a user, and many rows on one timestamp."""
    e = small("events")
    same = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    return (
        e.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 4))
        .withColumn("ts", F.when(F.col("event_id").between(200, 400), same).otherwise(F.col("ts")))
        .cache())


def frame(df, key="event_id"):
    pdf = df.toPandas()
    return pdf[sorted(pdf.columns)].sort_values(key).reset_index(drop=True)


def test_segments_are_bounded_and_in_order(events):
    large = large_keys(events.select("user_id"), ["user_id"], 50)
    segments = (
        with_segments(events, ["user_id"], ["ts", "event_id"], large, 50)
        .groupBy("user_id", "_segment")
        .agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("lo"),
             F.max(F.struct("ts", "event_id")).alias("hi"))
        .orderBy("user_id", "_segment").collect())
    assert max(r["n"] for r in segments) < 100
    assert len(segments) > 15
    for a, b in zip(segments, segments[1:]):
        if a["user_id"] == b["user_id"]:
            assert tuple(a["hi"]) < tuple(b["lo"])


def test_no_large_key_means_plain_plan(events):
    assert large_keys(events.select("user_id"), ["user_id"], 10_000) is None


def test_look_back(events):
    def add(df, window):
        return df.withColumns({f"lag{i}": F.lag("event_id", i).over(window) for i in (1, 2, 3)})

    plain = Ordered(events, ["user_id"], ["ts", "event_id"]).look_back(3, add).rows()
    split = Ordered(events, ["user_id"], ["ts", "event_id"], 25).look_back(3, add).rows()
    pd.testing.assert_frame_equal(frame(plain), frame(split))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(events, inclusive):
    values = {
        "top": ("max", F.col("value")), "n": ("sum", F.lit(1)), "first_type": ("first", F.col("event_type")),
        "last_error": ("last", F.when(F.col("event_type") == "error", F.col("event_id")))}
    plain = Ordered(events, ["user_id"], ["ts", "event_id"]).running(values, inclusive).rows()
    split = Ordered(events, ["user_id"], ["ts", "event_id"], 25).running(values, inclusive).rows()
    pd.testing.assert_frame_equal(frame(plain), frame(split))


@pytest.mark.parametrize("rows_per_task", [100, 200])
def test_rate_limit(events, rows_per_task):
    plain = rate_limit(events, "user_id", "ts", "event_id", SLOW)
    split = rate_limit(events, "user_id", "ts", "event_id", SLOW, rows_per_task)
    assert 0.1 < frame(plain).allowed.mean() < 0.9
    pd.testing.assert_frame_equal(frame(plain), frame(split))


def test_rate_limit_against_loop(events):
    step, state, expected = bucket_step(SLOW), {}, {}
    for row in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        micros = int(pd.Timestamp(row.ts).value // 1000)
        expected[row.event_id], state[row.user_id] = step(micros, state.get(row.user_id))
    got = {r.event_id: r.allowed for r in rate_limit(events, "user_id", "ts", "event_id", SLOW).collect()}
    assert got == expected


def test_burst_of_seven(spark):
    rows = spark.createDataFrame([("u", f"2024-01-01 00:00:00.{i}", i) for i in range(7)], "u string, t string, i int")
    out = rate_limit(rows.withColumn("t", F.col("t").cast("timestamp")), "u", "t", "i").orderBy("i").collect()
    assert [r.allowed for r in out] == [True] * 5 + [False] * 2


def test_denied_burst_leaves_sustained_alone():
    step = bucket_step((("burst", 1.0, 1.0), ("sustained", 5.0, 0.001)))
    ok, state = step(0, None)
    assert ok and state == (0.0, 0.0, 0.0, 4.0)
    ok, state = step(100_000, state)
    assert not ok and state == (100_000.0, 0.1, 0.0, 4.0)


def test_burst_token_is_spent_when_sustained_denies():
    step = bucket_step((("burst", 5.0, 1.0), ("sustained", 1.0, 0.001)))
    _, state = step(0, None)
    ok, state = step(0, state)
    assert not ok and state[1] == 3.0


def test_cooldown(events):
    plain = cooldown(events, "user_id", "ts", "event_id", 7200.0)
    split = cooldown(events, "user_id", "ts", "event_id", 7200.0, 60)
    assert 0.1 < frame(plain).fires.mean() < 0.9
    pd.testing.assert_frame_equal(frame(plain), frame(split))


def test_cooldown_off_fires_always(events):
    assert cooldown(events, "user_id", "ts", "event_id", 0.0).where("not fires").isEmpty()


def test_first_and_last_n(events):
    few = first_n(events, ["user_id"], ["ts", "event_id"], 30)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    many = first_n(events, ["user_id"], ["ts", "event_id"], 1001, 50).where("rank <= 30")
    pd.testing.assert_frame_equal(frame(few), frame(many), check_dtype=False)
    assert last_n(events, "user_id", "ts", "event_id", 10).count() == 50


def test_last_n_beyond_the_window_limit(spark):
    many = spark.range(20_000).select(F.col("id").alias("i"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 4 > 0, "u").alias("k"))
    out = last_n(many, "k", "ts", "i", 3000, rows_per_task=1000).groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("lo")).collect()
    assert {r.k: (r.n, r.lo) for r in out} == {"u": (3000, 16_001), None: (3000, 8000)}


@pytest.mark.parametrize("name", ["uuid", "padded", "time"])
def test_any_order_type_is_cut(spark, name):
    """A hot key whose rows have one timestamp and ids that are texts, or times that are texts."""
    texts = {"uuid": F.md5(F.col("id").cast("string")), "padded": F.format_string("request-number-%012d", "id"),
             "time": F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "yyyy-MM-dd HH:mm:ss")}
    rows = spark.range(3000).select(
        F.when(F.col("id") % 5 > 0, "hot").otherwise("other").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("ts"),
        texts[name].alias("rid"), (F.col("id") % 7).alias("v"))
    order = ["rid", "v"] if name == "time" else ["ts", "rid"]
    large = large_keys(rows.select("k"), ["k"], 100)
    sizes = with_segments(rows, ["k"], order, large, 100).groupBy("k", "_segment").count().collect()
    assert max(r["count"] for r in sizes) < 250 and len(sizes) > 20
    cut = Ordered(rows, ["k"], order, 100).running({"total": ("sum", F.col("v"))}).rows()
    plain = Ordered(rows, ["k"], order, 10**6).running({"total": ("sum", F.col("v"))}).rows()
    pd.testing.assert_frame_equal(frame(cut, "rid"), frame(plain, "rid"), check_dtype=False)


def test_drift(spark, small):
    turns = small("embeddings").withColumn("user", F.col("vec_id") % 3).limit(150)
    plain = conversation_drift(turns, "user", "vec_id", "vec_id").drop("embedding")
    split = conversation_drift(turns, "user", "vec_id", "vec_id", rows_per_task=20).drop("embedding")
    pd.testing.assert_frame_equal(frame(plain, "vec_id"), frame(split, "vec_id"))


def test_time_ignores_changes_of_clocks(spark):
    """02:30 does not exist on that day in New York, 01:30 exists twice on the other."""
    texts = ["2024-03-10 01:30:00", "2024-03-10 02:30:00.000001", "2024-11-03 00:30:00", "2024-11-03 01:30:00", "2024-11-03 02:30:00"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
        got = [r[0] for r in df.select(micros(df, "ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [pd.Timestamp(t).value // 1000 for t in texts]
