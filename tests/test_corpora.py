import re
import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import hashing
from textguard.functions import vectors as vec
from textguard.operators import baseline as base
from textguard.operators import concentration, integrity
from textguard.operators.similarity import similar_documents


@pytest.fixture(scope="module")
def vectors(spark, small):
    return small("embeddings").select("vec_id", "embedding").cache()


@pytest.fixture(scope="module")
def matrix(vectors):
    return np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], dtype=float)


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"a key longer than one block " * 4])
def test_hmac(spark, key):
    df = spark.createDataFrame([("abc", "k"), ("déf", "k"), ("x", "other")], "m string, key_id string")
    out = hashing.sign(df, hashing.signing_keys(spark, {"k": key}), {"s": "m"}).collect()
    expected = {m: hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("abc", "déf")}
    assert {r.m: r.s for r in out} == expected | {"x": None}


def test_signature_verification(spark):
    keys = hashing.signing_keys(spark, {"k": b"secret"})
    good = hmac.new(b"secret", b"h", hashlib.sha256).hexdigest()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    df = spark.createDataFrame([("h", good, "k"), ("h", bad, "k"), ("h", None, "k"), ("h", good, "none")],
                               "m string, s string, key_id string")
    assert [r.signature_valid for r in hashing.verify(df, keys, "m", "s").collect()] == [True, False, False, False]


def test_keys_stay_out_of_plans(spark):
    df = spark.range(1).select(F.lit("m").alias("m"), F.lit("k").alias("key_id"))
    plan = hashing.sign(df, hashing.signing_keys(spark, {"k": b"hunter2"}), {"s": "m"})._jdf.queryExecution().toString()
    pad = bytes(b ^ 0x36 for b in b"hunter2")
    assert "hunter2" not in plan and pad.hex() not in plan.lower() and str(list(pad))[1:-1] not in plan


@pytest.fixture(scope="module")
def corpus(spark, small):
    docs = small("documents").select("doc_id", "text", F.timestamp_seconds("doc_id").alias("ts"))
    vectors = small("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id").cache()


@pytest.fixture(scope="module")
def registry(spark, corpus):
    return integrity.register_documents(corpus, hashing.signing_keys(spark, {"k": b"s"}), "ts", "k", embedding="embedding").cache()


def test_registry_hashes(corpus, registry):
    texts = {r.doc_id: r.text for r in corpus.collect()}
    for row in registry.collect():
        assert row.content_hash == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
        assert row.content_sig == hmac.new(b"s", row.content_hash.encode(), hashlib.sha256).hexdigest()


def test_verification(corpus, registry):
    assert integrity.verify_documents(corpus, registry, embedding="embedding").where("not is_valid").isEmpty()
    changed = (corpus.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" TAMPERED"))).otherwise(F.col("text")))
               .withColumn("embedding", F.when(F.col("doc_id") == 2, F.transform("embedding", lambda x: (x + 1).cast("float")))
                           .otherwise(F.col("embedding")))
               .withColumn("doc_id", F.when(F.col("doc_id") == 3, F.lit(-3)).otherwise(F.col("doc_id"))))
    failed = integrity.verify_documents(changed, registry, embedding="embedding").where("not is_valid").collect()
    assert {r.doc_id: r.reason for r in failed} == {
        1: integrity.CONTENT_MISMATCH, 2: integrity.VECTOR_MISMATCH, -3: integrity.UNREGISTERED}
    summary, failures = integrity.integrity_scan(changed, registry, embedding="embedding")
    n = corpus.count()
    assert summary.first().asDict() == {
        "total_documents": n, "verified_count": n - 3, "tampered_count": 3, "anomalous_count": 0}
    assert {r.doc_id: r.reason for r in failures.collect()} == {
        1: integrity.CONTENT_MISMATCH, 2: integrity.VECTOR_MISMATCH, 3: "missing"}


def test_anomalous_vector_fails(spark, corpus, vectors):
    baseline = base.vector_baseline(vectors)
    keys = hashing.signing_keys(spark, {"k": b"s"})
    odd = corpus.withColumn("embedding", F.when(F.col("doc_id") == 5, F.transform("embedding", lambda x: (x * 10).cast("float")))
                            .otherwise(F.col("embedding")))
    registered = integrity.register_documents(odd, keys, "ts", "k", embedding="embedding", baseline=baseline)
    assert [r.doc_id for r in registered.where("tampering_detected").collect()] == [5]
    failed = integrity.verify_documents(odd, registered, embedding="embedding", baseline=baseline).where("not is_valid").collect()
    assert [(r.doc_id, r.reason) for r in failed] == [(5, integrity.ANOMALOUS)]


def test_last_write_wins(spark, corpus, registry):
    keys = hashing.signing_keys(spark, {"k": b"s"})
    copies = corpus.where("doc_id = 7").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(500))))
    copies = copies.withColumn("text", F.concat("text", F.col("i").cast("string"))).withColumn("ts", F.timestamp_seconds(F.col("i") + 1000))
    newer = integrity.register_documents(copies, keys, "ts", "k", embedding="embedding")
    assert newer.count() == 1
    both = integrity.upsert(registry, newer)
    assert both.count() == registry.count()
    text = corpus.where("doc_id = 7").first().text + "500"
    assert both.where("doc_id = 7").first().content_hash == hashlib.sha256(text.encode()).hexdigest()


def test_scan_interval(corpus, registry):
    assert integrity.integrity_scan(corpus, registry, last_scan=1000.0, now=2000.0) is None
    assert integrity.integrity_scan(corpus, registry, last_scan=1000.0, now=2000.0, force=True) is not None


def test_baseline(vectors, matrix):
    row = base.vector_baseline(vectors.repartition(7)).first()
    norms = np.linalg.norm(matrix, axis=1)
    np.testing.assert_allclose(row["mean"], matrix.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(np.array(row.covariance), np.cov(matrix.T), atol=1e-12)
    assert row.total_documents == len(matrix)
    np.testing.assert_allclose([row.norm_mean, row.norm_std], [norms.mean(), norms.std()], atol=1e-9)


def test_baseline_needs_samples(spark, vectors):
    few = vectors.where("vec_id < 99")
    assert base.vector_baseline(few).isEmpty()
    scored = base.vector_anomalies(vectors, base.vector_baseline(few))
    assert scored.where("is_anomaly or anomaly_score <> 0").isEmpty()


def test_distances(vectors, matrix):
    out = base.vector_distances(vectors, base.vector_baseline(vectors)).orderBy("vec_id").collect()
    diff = matrix - matrix.mean(axis=0)
    expected = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(np.cov(matrix.T)), diff))
    np.testing.assert_allclose([r.mahalanobis for r in out], expected, rtol=1e-9)


def test_singular_covariance(spark):
    df = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(200)], "vec_id int, embedding array<double>")
    baseline = base.vector_baseline(df)
    scored = base.vector_distances(df, baseline)
    assert scored.where("mahalanobis is not null or baseline_usable").isEmpty(), "an unusable baseline is reported"
    checked = base.vector_poisoning(df, df).select("poisoning_detection.*")
    assert checked.where("is_poisoned or baseline_usable").isEmpty()
    assert base.vector_distances(df, baseline, ridge=0.1).where("mahalanobis > 0").count() > 100


def test_poisoning_and_dimensions(spark, vectors):
    mixed = vectors.unionByName(vectors.where("vec_id < 40").select(
        (F.col("vec_id") + 1000).alias("vec_id"), F.transform("embedding", lambda x: (x * 10).cast("float")).alias("embedding")))
    mixed = mixed.unionByName(spark.createDataFrame([(5000, [1.0, 2.0]), (5001, None)], "vec_id long, embedding array<float>"))
    out = {r.vec_id: r.poisoning_detection for r in base.vector_poisoning(mixed, vectors).collect()}
    assert all(out[i + 1000].is_poisoned and not out[i].is_poisoned for i in range(40))
    assert all(0 <= p.similarity_score <= 1 for i, p in out.items() if i < 5000)
    assert not out[5000].is_poisoned and not out[5001].is_poisoned


def test_top_k_against_brute_force(spark, vectors, matrix):
    # A third of the documents are copies of one vector.
    copies = vectors.where("vec_id = 3").withColumn("vec_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_250))))
    docs = vectors.unionByName(copies.select("vec_id", "embedding")).repartition(5)
    queries = vectors.where("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    ids = np.array([*range(len(matrix)), *range(10_000, 10_251)])
    unit = np.vstack([matrix, np.repeat(matrix[3:4], 251, axis=0)])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    for blocks in (2048, 7):
        got = similar_documents(queries, docs, "query_id", "vec_id", min_similarity=0.2, max_queries=blocks).collect()
        expected = set()
        for q in range(30):
            sims = np.round(unit @ unit[q], 9)
            order = sorted((i for i in range(len(ids)) if sims[i] >= 0.2), key=lambda i: (-sims[i], ids[i]))[:5]
            expected |= {(q, int(ids[i]), r + 1) for r, i in enumerate(order)}
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == expected


def test_top_k_without_queries(spark, vectors):
    none = vectors.where("vec_id < 0").withColumnRenamed("vec_id", "query_id")
    assert similar_documents(none, vectors, "query_id", "vec_id").isEmpty()


def test_row_correlation(spark):
    rng = np.random.default_rng(1)
    rows = rng.random((6, 10))
    rows[3] = 0.5
    df = spark.createDataFrame([(rows.tolist(),)], "r array<array<double>>")
    got = df.select(vec.mean_row_correlation(F.col("r"), F.size("r"))).first()[0]
    with np.errstate(invalid="ignore"):
        c = np.nan_to_num(np.corrcoef(rows))
    expected = (c.sum() - np.trace(c)) / 30
    assert abs(got - expected) < 1e-9


def test_concentration(spark):
    df = spark.createDataFrame([([0.0, 5.0, 0.0],), ([1.0, 1.0, 1.0, 1.0],), ([0.0, 0.0],)], "w array<double>")
    got = [(round(a, 6), round(b, 6)) for a, b in df.select(vec.concentration(F.col("w")), vec.entropy(F.col("w"))).collect()]
    assert got == [(1.0, 0.0), (0.25, 1.386294), (0.0, 0.0)]


def test_long_sequences_are_flagged(spark):
    df = spark.createDataFrame([([0.1] * 4,), ([0.1] * (rules.MAX_SEQUENCE + 1),)], "v array<double>")
    out = concentration.activation_check(df, "v", vec.reshape(F.col("v"), 2), F.lit(0.0), F.lit(1.0), "v").collect()
    assert [r.activation_check.sequence_length_warning for r in out] == [False, True]


def test_moments_merge_over_exchanges(spark, vectors):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        plan = base.vector_moments(vectors)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    nodes = re.findall(r"MapInArrow|Exchange \S*\(?\d*", plan)
    assert [n for n in nodes if "70" in n or "(3" in n or "Single" in n] and len([n for n in nodes if n.startswith("Exchange")]) == 3
    kinds = ["M" if n.startswith("M") else "E" for n in nodes]
    assert "".join(kinds) == "MEMEMEM", "an exchange between all merges"


def test_texts_hashed_before_a_join_give_the_same_registry_and_scan(spark):
    from textguard.functions import hashing
    from textguard.operators import integrity

    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "c"), (None, "d")], "doc_id long, text string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    keys = hashing.signing_keys(spark, {"k1": b"key"})
    hashed = integrity.text_hashes(docs)
    assert hashed.columns == ["doc_id", "ts", "content_hash"]
    whole, narrow = integrity.register_documents(docs, keys, "ts", "k1"), integrity.register_documents(hashed, keys, "ts", "k1", None)
    assert sorted(map(str, whole.collect())) == sorted(map(str, narrow.collect()))
    a, b = integrity.integrity_scan(docs, whole), integrity.integrity_scan(hashed, narrow, None)
    assert a[0].collect() == b[0].collect() and sorted(map(str, a[1].collect())) == sorted(map(str, b[1].collect()))
