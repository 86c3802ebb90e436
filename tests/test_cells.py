"""Top-k similarity over cells against all pairs."""

import numpy as np
import pytest

from textguard.operators import cells
from textguard.operators.cells import similar_by_cells
from textguard.operators.similarity import similar_documents

TYPES = "id long, e array<float>"


def clustered(n, dim, rng, clusters=12, spread=0.15):
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def brute(queries, docs, k, least):
    out = []
    for q, x in queries:
        found = []
        for d, y in docs:
            if x is None or y is None or not len(x) or len(x) != len(y) or not np.isfinite([*x, *y]).all():
                continue
            a, b = np.array(x, float), np.array(y, float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            s = round(float(a @ b / n), 9) if n else 0.0
            if s >= least:
                found.append((-s, d))
        out += [(q, d, round(-s, 6), r) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.q, r.d, round(r.similarity, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("least, k", [(0.2, 5), (0.9, 3), (-1.0, 7)])
def test_all_pairs(spark, least, k):
    rng = np.random.default_rng(k)
    docs = list(enumerate(clustered(400, 8, rng).tolist())) + [(1000 + i, v) for i, v in enumerate(clustered(30, 3, rng).tolist())]
    docs += [(2000 + i, docs[i][1]) for i in range(20)]  # ties
    docs += [(3000, [0.0] * 8), (3001, None), (3002, []), (3003, [float("nan")] * 8), (3004, [1.0, float("inf")] + [0.0] * 6), (3005, [1.0] * 5)]
    queries = [(i, v) for i, v in enumerate(clustered(60, 8, rng).tolist())] + [(100, [0.0] * 8), (101, None), (102, docs[405][1]), (103, docs[3][1]),
                                                                              (104, [1.0] * 5), (105, [2.0] * 6)]
    q = spark.createDataFrame(queries, "q long, e array<float>")
    d = spark.createDataFrame(docs, "d long, e array<float>")
    want = brute(queries, docs, k, least)
    for cells, rows in ((16, 64), (200, 10_000)):
        assert got(similar_by_cells(q, d, "q", "d", "e", k, least, cells=cells, rows=rows)) == want
    assert got(similar_documents(q, d, "q", "d", "e", k, least, max_queries=10)) == want
    assert similar_by_cells(q.where("false"), d, "q", "d", "e", k, least).collect() == []
    assert similar_by_cells(q, d.where("false"), "q", "d", "e", k, least).collect() == []


def test_clusters_are_pruned_and_queries_stay_on_executors(spark, tmp_path):
    rng = np.random.default_rng(1)
    points = clustered(10_500, 16, rng, clusters=30, spread=0.05)
    spark.createDataFrame([(i, v) for i, v in enumerate(points[:10_000].tolist())], "q long, e array<float>").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(i, v) for i, v in enumerate(points[10_000:].tolist())], "d long, e array<float>").write.parquet(str(tmp_path / "d"))
    q, d = spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "d"))
    plans = {}
    for n in (100, 10_000):
        found = similar_by_cells(q.where(f"q < {n}"), d, "q", "d", "e", 2, 0.2, cells=64)
        plans[n] = found._jdf.queryExecution().optimizedPlan().toString()
        assert plans[n].count("Relation") == plans[100].count("Relation") and "LocalRelation" not in plans[n]
    rows = found.collect()
    assert len(rows) == 20_000
    some = rng.choice(10_000, 200, replace=False)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    top = np.sort(unit[some] @ unit[10_000:].T, axis=1)[:, ::-1][:, :2]
    by = {(r.q, r["rank"]): r.similarity for r in rows}
    assert all(abs(by[int(s), r + 1] - top[i, r]) < 1e-6 for i, s in enumerate(some) for r in range(2))


def test_documents_go_to_blocks_of_queries_not_to_every_cell(spark):
    """Directions without clusters, where bounds leave everything: a document is sent once for each block of queries."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2_400, 24)).astype(np.float32).tolist()
    docs = spark.createDataFrame(list(enumerate(points)), "d long, e array<float>")
    queries = spark.createDataFrame(list(enumerate(points[:600])), "q long, e array<float>")
    sent = []

    def counted(k, names, types):
        match = matcher(k, names, types)
        total = sent[0]

        def count(queries, docs):
            total.add(len(docs))
            return match(queries, docs)
        return count

    assigner, router, matcher = cells._shipped()
    sent.append(spark.sparkContext.accumulator(0))
    shipped, cells._shipped = cells._shipped, lambda: (assigner, router, counted)
    try:
        found = cells.similar_by_cells(queries, docs, "q", "d", "e", 3, -1.0, cells=24, rows=800).collect()
    finally:
        cells._shipped = shipped
    assert len(found) == 1_800 and sum(r.q == r.d and r["rank"] == 1 for r in found) == 600
    assert sent[0].value <= 4 * 2_400
