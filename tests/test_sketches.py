"""Sketches against exact counts and ranks."""

import random

from pyspark.sql import functions as F

from textguard.operators import sketches


def test_ranks_within_the_stated_error(spark):
    rng = random.Random(4)
    rows = [(i, i % 5, [rng.gauss(0, 1) for _ in range(60)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, day long, e array<double>")
    exact = {day: sorted(x for i, d, e in rows if day - 3 <= d < day for x in e) for day in range(5)}
    for k, error in ((200, 0.03), (4096, 0.003)):
        daily = sketches.value_sketches(df, ["day"], "e", k)
        got = sketches.activation_ranks(df, "day", "e", 3, daily).select("id", "day", F.array_max("e").alias("top"), "activation_rank").collect()
        assert len(got) == 1000
        for r in got:
            if r.day == 0:
                assert r.activation_rank is None
            else:
                share = sum(x <= r.top for x in exact[r.day]) / len(exact[r.day])
                assert abs(r.activation_rank - share) < error + 0.001
    odd = spark.createDataFrame([(1, None), (1, [None, float("nan")]), (1, []), (2, [1.0, 2.0])], "day long, e array<double>")
    assert {r.day: r.n for r in sketches.value_sketches(odd, ["day"], "e").collect()} == {2: 2}
    assert sketches.activation_ranks(odd, "day", "e", 1).where("activation_rank is not null").count() == 0


def test_sets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.randrange(50)) for _ in range(600)] + [(None, 0, 1), (None, 1, 1), ("a", 0, None)]
    df = spark.createDataFrame(rows, "c string, day int, u int")
    daily = sketches.set_sketches(df, ["c", "day"], "u")
    sets = {}
    for c, day, u in rows:
        sets.setdefault((c, day), set()).update({u} - {None})
    want = {(c, d): (len(s), len(s & sets.get((c, d + 1), set())), len(s - sets.get((c, d + 1), set()))) for (c, d), s in sets.items()}
    assert {(r.c, r.day): (r.n, r.stayed, r.gone) for r in sketches.turnover(daily, "day", ["c"]).collect()} == want
    whole = {r.c: r.n for r in sketches.united(daily, ["c"]).select("c", F.theta_sketch_estimate("members").alias("n")).collect()}
    assert whole == {c: len(set().union(*[s for (k, _), s in sets.items() if k == c])) for c in ("a", "b", None)}


def test_large_sets_within_the_stated_error(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("day"), (F.col("id") % 130_001).alias("u"))
    exact = df.groupBy("day").agg(F.count_distinct("u").alias("n")).collect()
    got = {r.day: r.n for r in sketches.set_sketches(df, ["day"], "u").select("day", F.theta_sketch_estimate("members").alias("n")).collect()}
    assert all(abs(got[r.day] / r.n - 1) < 4 / 64 for r in exact)
