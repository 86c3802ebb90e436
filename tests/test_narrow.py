"""What the ordered passes shuffle, and drift over Arrow batches and segments."""

import re

import numpy as np
from pyspark.sql import functions as F

from textguard.operators.drift import drift_alerts, drift_values
from textguard.operators.sanitize import context_scores


def exchanged(df):
    """Columns that go into the exchanges by key `u`."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    repartitions = re.split(r"RepartitionByExpression|Window \[", plan)
    return repartitions[1] if len(repartitions) > 1 else plan


def test_only_ids_times_and_one_vector_are_shuffled(spark):
    df = spark.createDataFrame([("u", 1, 1, "some longer text", [1.0, 2.0])], "u string, ts int, i int, t string, e array<double>")
    plan = drift_alerts(df.withColumn("wide", F.lit("x")), "u", "ts", "i", "t", "e", rows_per_task=10)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    project = re.search(r"Project \[([^\]]*)\]", below).group(1)
    names = [re.sub(r".* AS ", "", c.strip()).split("#")[0] for c in project.split(", ")]
    assert sorted(names) == ["_vector", "i", "ts", "u"], project
    scores = context_scores(df.withColumn("ts", F.timestamp_seconds("ts")), "u", "ts", "i", "t")
    text = scores._jdf.queryExecution().executedPlan().toString()
    exchange = text[text.index("Exchange"):]
    assert "xxhash64" in exchange and not re.search(r"Exchange[^\n]*\bt#", text)


def plain(rows):
    out, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if v is None or not len(v):
            continue
        v = np.array(v)
        first, last, sim, n, md, mc = state.get(k, (v, v, 0.0, 0, -9.0, -9.0))

        def cos(a, b):
            length = np.linalg.norm(a) * np.linalg.norm(b)
            return a @ b / length if length else 0.0
        s, d = (cos(v, last), 1 - cos(v, first)) if n else (0.0, 0.0)
        c = abs(s - sim) if n >= 2 else 0.0
        md, mc = max(md, d), max(mc, c)
        state[k] = (first, v, s, n + 1, md, mc)
        out[i] = (s, d, c, md, mc)
    return out


def test_drift_over_batches_and_segments(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 7 == 0], i, rng.normal(size=3).tolist()) for i in range(24_000)]
    rows += [("c", 30_000, [0.0, 0.0, 0.0]), ("c", 30_001, [1.0, 0.0, 0.0]), ("c", 30_002, None), ("c", 30_003, []), ("c", 30_004, [1.0, 1.0, 0.0]), ("d", 40_000, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "k string, i int, e array<double>")
    want = plain(rows)
    for limits in ({}, {"rows_per_task": 1500}, {"bytes_per_task": 200_000}):
        got = {r.i: (r.similarity, r.drift, r.change_rate, r.max_drift, r.max_change_rate) for r in drift_values(df, "k", "i", "i", "e", **limits).collect()}
        assert got.keys() == want.keys()
        assert all(abs(a - b) < 1e-9 for i in want for a, b in zip(got[i], want[i])), limits
