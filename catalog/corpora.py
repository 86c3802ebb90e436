"""Queries over document corpora and vectors: integrity, outliers, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import load
from textguard.durable import durable, scratch_path, spread
from textguard.functions import hashing
from textguard.functions import vectors as vec
from textguard.operators import baseline as base
from textguard.operators import concentration, integrity, sketches
from textguard.operators.similarity import similar_documents
from textguard.sources.registry import read_registry, write_registry

KEY = b"textguard test key"
# HMAC blocks of KEY, as blobs for SQL.
_INNER = "".join(f"\\x{b ^ 0x36:02X}" for b in KEY.ljust(64, b"\0"))
_OUTER = "".join(f"\\x{b ^ 0x5C:02X}" for b in KEY.ljust(64, b"\0"))


def sql_hmac(message):
    return f"sha256('{_OUTER}'::BLOB || from_hex(sha256('{_INNER}'::BLOB || ({message})::BLOB)))"


def sql_vector_hash(vector):
    return f"sha256(array_to_string(list_transform({vector}, lambda x: CAST(floor(x::DOUBLE * 1e6::DOUBLE + 0.5) AS BIGINT)::VARCHAR), ','))"


def corpus(spark, sf):
    """Documents with the vector of the same number, where there is one; some of the vectors are outliers."""
    return with_vectors(spark, sf, texts(spark, sf))


def texts(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id")).alias("ts"))


def with_vectors(spark, sf, d):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(
        F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x: (x * 16).cast("float"))).otherwise(F.col("embedding")).alias("embedding"))
    return d.join(e, "doc_id", "left")


_CORPUS = """(SELECT d.doc_id, d.text, CASE WHEN e.vec_id % 13 = 0 THEN list_transform(e.embedding, lambda x: (x * 16)::FLOAT) ELSE e.embedding END AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def registered(spark, sf, docs=None):
    keys = hashing.signing_keys(spark, {"k1": KEY})
    content = "text"
    if docs is None:  # texts are hashed before the join, which shuffles hashes only
        docs, content = with_vectors(spark, sf, integrity.text_hashes(texts(spark, sf))), None
    return integrity.register_documents(
        docs, keys, "ts", "k1", content, embedding="embedding", baseline=scattered_baseline(spark, sf))


def doc_registry(spark, sf):
    return registered(spark, sf).select("doc_id", "content_hash", "vector_hash", "content_sig", "vector_sig", "is_valid")


DOC_REGISTRY = f"""
SELECT doc_id, content_hash, vector_hash, {sql_hmac('content_hash')} AS content_sig, {sql_hmac('vector_hash')} AS vector_sig,
       true AS is_valid
FROM (SELECT doc_id, sha256(text) AS content_hash, CASE WHEN embedding IS NOT NULL THEN {sql_vector_hash('embedding')} END AS vector_hash
      FROM {_CORPUS})"""


def registry_upsert(spark, sf):
    """All documents registered, the English ones once more, some with a new text."""
    docs = corpus(spark, sf)
    later = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    english = load(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    later = later.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).join(english, "doc_id", "left_semi")
    both = integrity.upsert(registered(spark, sf, docs), registered(spark, sf, later))
    return both.select("doc_id", "content_hash", F.unix_seconds("last_verified").alias("written"))


REGISTRY_UPSERT = """
SELECT doc_id, sha256(text || CASE WHEN lang = 'en' AND doc_id % 3 = 0 THEN ' v2' ELSE '' END) AS content_hash,
       doc_id + CASE WHEN lang = 'en' THEN 86400 ELSE 0 END AS written FROM documents"""


def registry_batches(spark, sf):
    """A stored registry over three batches: all documents; the English ones, some with a new text; and
    every fifth document with an older text that must not win."""
    path = scratch_path(spark, "registry")
    docs = corpus(spark, sf)
    english = load(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    later = later.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).join(english, "doc_id", "left_semi")
    older = docs.where(F.col("doc_id") % 5 == 0).withColumn("text", F.lit("an old text")).withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))
    for batch in (docs, later, older):
        write_registry(registered(spark, sf, batch), path, buckets=32)
    return read_registry(spark, path).select("doc_id", "content_hash", F.unix_seconds("last_verified").alias("written"))


def stored(spark, sf):
    """What storage holds (texts as hashes): some texts tampered with, some vectors shifted, some
    documents stored under a new number, hence gone under the old one."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" TAMPERED"))).otherwise(F.col("text"))
    d = with_vectors(spark, sf, integrity.text_hashes(texts(spark, sf).drop("ts").withColumn("text", text)))
    shifted = F.transform("embedding", lambda x: (x + 1).cast("float"))
    vector = F.when(F.col("doc_id") % 11 == 0, shifted).otherwise(F.col("embedding"))
    moved = F.when(F.col("doc_id") % 19 == 5, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    return d.withColumn("embedding", vector).withColumn("doc_id", moved)


_STORED = f"""(SELECT CASE WHEN doc_id % 19 = 5 THEN doc_id + 10000000 ELSE doc_id END AS doc_id,
     CASE WHEN doc_id % 19 = 5 THEN 'not registered' WHEN doc_id % 7 = 0 THEN 'content hash mismatch'
     WHEN doc_id % 11 = 0 AND embedding IS NOT NULL THEN 'vector hash mismatch'
     WHEN doc_id % 13 = 0 AND embedding IS NOT NULL THEN 'anomalous vector' END AS reason,
     doc_id % 13 = 0 AND embedding IS NOT NULL AS anomalous FROM {_CORPUS})"""


def verify_documents(spark, sf):
    v = integrity.verify_documents(
        stored(spark, sf), registered(spark, sf), None, embedding="embedding", baseline=scattered_baseline(spark, sf))
    return v.select("doc_id", "is_valid", "reason")


VERIFY_DOCUMENTS = f"SELECT doc_id, reason IS NULL AS is_valid, reason FROM {_STORED}"


def scan(spark, sf):
    return integrity.integrity_scan(
        stored(spark, sf), registered(spark, sf), None, embedding="embedding", baseline=scattered_baseline(spark, sf))


def integrity_scan(spark, sf):
    return scan(spark, sf)[0]


_SCANNED = f"""(SELECT doc_id, reason, anomalous FROM {_STORED} WHERE reason IS DISTINCT FROM 'not registered'
  UNION ALL SELECT doc_id, 'missing', doc_id % 13 = 0 AND embedding IS NOT NULL FROM {_CORPUS} WHERE doc_id % 19 = 5)"""
INTEGRITY_SCAN = f"""SELECT count(*) AS total_documents, count(*) FILTER (reason IS NULL) AS verified_count,
  count(*) FILTER (reason IS NOT NULL) AS tampered_count, count(*) FILTER (anomalous) AS anomalous_count FROM {_SCANNED}"""


def integrity_failures(spark, sf):
    return scan(spark, sf)[1]


INTEGRITY_FAILURES = f"SELECT doc_id, reason FROM {_SCANNED} WHERE reason IS NOT NULL"


def unregistered_documents(spark, sf):
    return integrity.unregistered(stored(spark, sf), registered(spark, sf)).select("doc_id")


UNREGISTERED_DOCUMENTS = f"SELECT doc_id FROM {_STORED} WHERE reason = 'not registered'"


def missing_documents(spark, sf):
    return integrity.missing(registered(spark, sf), stored(spark, sf)).select("doc_id")


MISSING_DOCUMENTS = "SELECT doc_id FROM documents WHERE doc_id % 19 = 5"


def hmac_verify(spark, sf):
    """Signatures of all documents, some with the last digit changed, some with a foreign key."""
    keys = hashing.signing_keys(spark, {"k1": KEY, "k2": b"another key"})
    key_id = F.when(F.col("doc_id").isNotNull(), F.lit("k1"))
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), key_id.alias("key_id"))
    s = hashing.sign(d, keys, {"signature": "content_hash"})
    last = F.translate(F.substring("signature", 64, 1), "0123456789abcdef", "123456789abcdef0")
    s = (s.withColumn("signature", F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("signature", 1, 63), last))
                      .otherwise(F.col("signature")))
         .withColumn("key_id", F.when(F.col("doc_id") % 7 == 1, "k2").when(F.col("doc_id") % 7 == 2, "k3").otherwise("k1")))
    return hashing.verify(s, keys, "content_hash", "signature").select("doc_id", "signature", "signature_valid")


HMAC_VERIFY = f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substring(sig, 1, 63) || translate(substring(sig, 64, 1), '0123456789abcdef', '123456789abcdef0')
       ELSE sig END AS signature, doc_id % 5 <> 0 AND doc_id % 7 NOT IN (1, 2) AS signature_valid
FROM (SELECT doc_id, {sql_hmac('sha256(text)')} AS sig FROM documents)"""


# Planted vectors: each once more, ten times as long; kept out of the baseline.
def vectors(spark, sf):
    return spread(load(spark, sf, "embeddings").select("vec_id", "embedding"))


def with_outliers(spark, sf):
    v = vectors(spark, sf)
    long = v.select(
        (F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: (x * 10).cast("float")).alias("embedding"))
    return v.unionByName(long)


_OUTLIERS = """(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: x * 10::FLOAT)::DOUBLE[] FROM embeddings)"""


def vector_baseline(spark, sf):
    """Mean and covariance, one row per pair of dimensions."""
    b = base.vector_baseline(vectors(spark, sf))
    rows = b.select("total_documents", "mean", F.posexplode("covariance").alias("i", "row"))
    return rows.select("total_documents", "i", F.round(F.element_at("mean", F.col("i") + 1), 6).alias("mean"),
                       F.posexplode("row").alias("j", "c")).select(
        "total_documents", "i", "j", "mean", F.round("c", 8).alias("covariance"))


_LONG = "(SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
VECTOR_BASELINE = f"""
SELECT count(*) AS total_documents, a.i AS i, b.i AS j, round(avg(a.x), 6) AS mean, round(covar_samp(a.x, b.x), 8) AS covariance
FROM {_LONG} a JOIN {_LONG} b ON a.vec_id = b.vec_id GROUP BY a.i, b.i"""


def vector_norms(spark, sf):
    b = base.vector_baseline(vectors(spark, sf))
    return b.select("dim", F.round("norm_mean", 6).alias("norm_mean"), F.round("norm_std", 6).alias("norm_std"))


VECTOR_NORMS = """SELECT 64 AS dim, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std
FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""


def vector_anomalies(spark, sf):
    """Vectors a tenth longer are told by their norm, those ten times as long by both measures."""
    longer = vectors(spark, sf).select((F.col("vec_id") + 2_000_000).alias("vec_id"), F.transform(
        "embedding", lambda x: (x * F.lit(1.125).cast("float")).cast("float")).alias("embedding"))
    planted = with_outliers(spark, sf).unionByName(longer)
    a = base.vector_anomalies(planted, scattered_baseline(spark, sf))
    return a.select("vec_id", F.round("anomaly_score", 4).alias("anomaly_score"), "is_anomaly", "baseline_usable")


def scattered_baseline(spark, sf):
    """A baseline of vectors of three lengths, so that norms have a spread."""
    scale = F.lit(1.0) + F.pmod("vec_id", F.lit(3)) / 256
    return base.vector_baseline(vectors(spark, sf).withColumn("embedding", F.transform(
        "embedding", lambda x: x.cast("double") * scale)))


# The inverse covariance by Gauss-Jordan elimination, one pivot per step.
_INVERSE = f"""
cov AS (SELECT a.i AS i, list(covar ORDER BY a.j) AS row FROM (
          SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS covar
          FROM {_LONG} a JOIN {_LONG} b ON a.vec_id = b.vec_id GROUP BY a.i, b.i) a GROUP BY a.i),
start AS (SELECT list(list_concat(row, list_transform(range(64), lambda k: (k = i)::INT::DOUBLE)) ORDER BY i) AS m FROM cov),
steps AS (SELECT 0 AS k, m FROM start
          UNION ALL
          SELECT k + 1, list_transform(m, lambda row, n: CASE WHEN n = k + 1 THEN list_transform(row, lambda x: x / m[k + 1][k + 1])
             ELSE list_transform(row, lambda x, c: x - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END)
          FROM steps WHERE k < 64),
inv AS (SELECT list_transform(m, lambda row: row[65:128]) AS q FROM steps WHERE k = 64),
mean AS (SELECT list(avg ORDER BY i) AS mu FROM (SELECT i, avg(x) AS avg FROM {_LONG} GROUP BY i))"""
_DISTANCES = f"""SELECT vec_id, v, sqrt(list_dot_product(d, list_transform(q, lambda row: list_dot_product(row, d)))) AS mahalanobis
FROM (SELECT vec_id, v, q, list_transform(list_zip(v, mu), lambda z: z[1] - z[2]) AS d FROM {_OUTLIERS}, inv, mean)"""
_SCATTERED = "(SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * (1 + (vec_id % 3) / 256.0::DOUBLE) AS x FROM embeddings)"
_LONGER = f"""(SELECT * FROM {_OUTLIERS} UNION ALL
  SELECT vec_id + 2000000, list_transform(embedding, lambda x: (x * 1.125::FLOAT)::FLOAT)::DOUBLE[] FROM embeddings)"""
VECTOR_ANOMALIES = f"""WITH RECURSIVE {_INVERSE.replace(_LONG, _SCATTERED)},
norms AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM (SELECT sqrt(sum(x * x)) AS n FROM {_SCATTERED} GROUP BY vec_id)),
scores AS (SELECT vec_id, greatest(mahalanobis, abs(sqrt(list_dot_product(v, v)) - m) / s) AS score FROM ({_DISTANCES.replace(_OUTLIERS, _LONGER)}), norms)
SELECT vec_id, round(score, 4) AS anomaly_score, score > 2.5 * sqrt(64) AS is_anomaly, true AS baseline_usable FROM scores"""


def vector_poisoning(spark, sf):
    p = base.vector_poisoning(with_outliers(spark, sf), vectors(spark, sf))
    r = F.col("poisoning_detection")
    return p.select("vec_id", r["is_poisoned"].alias("is_poisoned"), F.round(r["mahalanobis_distance"], 4).alias("distance"),
                    F.round(r["similarity_score"], 6).alias("similarity"))


VECTOR_POISONING = f"""WITH RECURSIVE {_INVERSE}
SELECT vec_id, mahalanobis > 2.5 * sqrt(64) AS is_poisoned, round(mahalanobis, 4) AS distance,
       round((1.0 + list_cosine_similarity(v, mu)) / 2.0, 6) AS similarity FROM ({_DISTANCES}), mean"""


def baseline_refresh(spark, sf):
    """A baseline of some labels, grown by all other vectors and the outliers,
    from which the outliers are left out, equals the baseline of all."""
    known = load(spark, sf, "embeddings").where("label < 5").select("vec_id", "embedding")
    added = with_outliers(spark, sf).join(known, "vec_id", "left_anti")
    checked = base.vector_poisoning(added, known)
    b = base.baseline_from(base.refreshed_moments(base.vector_moments(known), checked))
    return b.select("total_documents", F.posexplode("mean").alias("i", "m")).select(
        "total_documents", "i", F.round("m", 6).alias("mean"))


BASELINE_REFRESH = f"SELECT count(*) AS total_documents, i, round(avg(x), 6) AS mean FROM {_LONG} GROUP BY i"


def activation_ranks_query(spark, sf):
    """Where a vector's largest value stands among all values of the three days before (ten days, by
    number), from sketches per day that are large enough to be exact on the test tables."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding", F.pmod("vec_id", F.lit(10)).alias("day"))
    daily = durable(sketches.value_sketches(e, ["day"], "embedding", k=65535))
    return sketches.activation_ranks(e, "day", "embedding", 3, daily).select("vec_id", "day", F.round("activation_rank", 6).alias("activation_rank"))


ACTIVATION_RANKS = """
WITH x AS (SELECT vec_id % 10 AS day, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT day + k AS day, x, count(*) AS n FROM x, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL),
c AS (SELECT day, x, sum(n) OVER (PARTITION BY day ORDER BY x) AS upto, sum(n) OVER (PARTITION BY day) AS total FROM b),
t AS (SELECT vec_id, vec_id % 10 AS day, list_max(embedding)::DOUBLE AS top FROM embeddings)
SELECT t.vec_id, t.day, round(CASE WHEN t.day > 0 THEN (1000 * coalesce(c.upto, 0) // (SELECT max(total) FROM c d WHERE d.day = t.day)) / 1000.0::DOUBLE END, 6) AS activation_rank
FROM t ASOF LEFT JOIN c ON c.day = t.day AND t.top >= c.x"""


def similar_documents_query(spark, sf):
    """For the mean vector of each label the five most similar vectors."""
    e = load(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    queries = parts.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    found = similar_documents(queries, e, "label", "vec_id", min_similarity=0.2)
    return found.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


SIMILAR_DOCUMENTS = """
WITH q AS (SELECT label, list(m ORDER BY i) AS c FROM (
             SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
             GROUP BY label, i) GROUP BY label),
s AS (SELECT q.label, e.vec_id, round(list_cosine_similarity(q.c, e.embedding::DOUBLE[]), 9) AS sim FROM q, embeddings e)
SELECT label, vec_id, round(sim, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0.2) WHERE rank <= 5"""


def similar_documents_join(spark, sf):
    """Every twentieth vector against all, by the join that any number of queries can take."""
    e = load(spark, sf, "embeddings")
    asked = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = similar_documents(asked, e, "query_id", "vec_id", min_similarity=0.2, max_queries=0)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


SIMILAR_DOCUMENTS_JOIN = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.e, d.e), 9) AS sim
      FROM v q JOIN v d ON q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(sim, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= 0.2) WHERE rank <= 5"""


def activation_check(spark, sf):
    """Vectors read as attention: some with all weight on one place, some with equal rows."""
    v = vectors(spark, sf)
    one = F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(5.0)).otherwise(F.lit(0.0)).cast("float"))
    repeated = F.flatten(F.array_repeat(F.slice("embedding", 1, 8), 8))
    large = F.transform("embedding", lambda x: (x * 40).cast("float"))
    v = v.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, one).when(F.col("vec_id") % 9 == 1, repeated)
                     .when(F.col("vec_id") % 9 == 2, large).otherwise(F.col("embedding")))
    checked = concentration.activation_check(
        v, "embedding", vec.reshape(F.col("embedding"), 8), F.lit(0.0), F.lit(0.125), "embedding")
    r = F.col("activation_check")
    return checked.select(
        "vec_id", r["is_poisoned"].alias("is_poisoned"), r["anomaly_type"].alias("anomaly_type"),
        F.round(r["concentration"], 6).alias("concentration"), F.round(r["entropy"], 6).alias("entropy"),
        F.round(r["activation_score"], 4).alias("activation_score"),
        F.round(r["attention_correlation_score"], 5).alias("correlation"))


ACTIVATION_CHECK = """
WITH v AS (SELECT vec_id, (CASE vec_id % 9
      WHEN 0 THEN list_transform(range(64), lambda i: CASE WHEN i = 3 THEN 5.0 ELSE 0.0 END::FLOAT)
      WHEN 1 THEN flatten(list_transform(range(8), lambda i: embedding[1:8]))
      WHEN 2 THEN list_transform(embedding, lambda x: x * 40::FLOAT) ELSE embedding END)::DOUBLE[] AS e FROM embeddings),
w AS (SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS x FROM v),
t AS (SELECT vec_id, sum(abs(x)) AS total, max(abs(x)) AS top, max(abs(x)) / 0.125::DOUBLE AS z FROM w GROUP BY vec_id),
p AS (SELECT vec_id, max(top / total) AS conc, -sum(CASE WHEN x = 0 THEN 0.0 ELSE abs(x) / total * ln(abs(x) / total) END) AS entropy, max(z) AS z
      FROM w JOIN t USING (vec_id) GROUP BY vec_id),
r AS (SELECT vec_id, i // 8 AS row, i % 8 AS col, x FROM w),
c AS (SELECT a.vec_id, a.row AS r1, b.row AS r2, CASE WHEN stddev_pop(a.x) = 0 OR stddev_pop(b.x) = 0 THEN 0.0 ELSE corr(a.x, b.x) END AS rho
      FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.col = b.col AND a.row <> b.row GROUP BY ALL),
m AS (SELECT vec_id, avg(rho) AS rho FROM c GROUP BY vec_id),
k AS (SELECT vec_id, conc, entropy, z, rho, CASE WHEN conc > 0.9 THEN 'attention_concentration' WHEN z > 6 THEN 'extreme_values'
             WHEN rho > 0.8 THEN 'correlated_attention' END AS kind FROM p JOIN m USING (vec_id))
SELECT vec_id, kind IS NOT NULL AS is_poisoned, kind AS anomaly_type, round(conc, 6) AS concentration, round(entropy, 6) AS entropy,
       round(z, 4) AS activation_score, round(rho, 5) AS correlation FROM k"""


def array_stats(spark, sf):
    s = concentration.array_distribution_stats(vectors(spark, sf), "embedding")
    return s.select("samples", "length_max", *[F.round(c, 6).alias(c) for c in (
        "mean_attention_entropy", "value_mean", "value_std", "value_min", "value_max", "length_mean")])


ARRAY_STATS = f"""
WITH t AS (SELECT vec_id, sum(abs(x)) AS total FROM {_LONG} GROUP BY vec_id),
h AS (SELECT vec_id, -sum(abs(x) / total * ln(abs(x) / total)) AS e FROM {_LONG} JOIN t USING (vec_id) GROUP BY vec_id)
SELECT (SELECT count(*) FROM h) AS samples, 64 AS length_max, round((SELECT avg(e) FROM h), 6) AS mean_attention_entropy,
       round(avg(x), 6) AS value_mean, round(stddev_pop(x), 6) AS value_std, round(min(x), 6) AS value_min,
       round(max(x), 6) AS value_max, 64.0::DOUBLE AS length_mean FROM {_LONG}"""

QUERIES = {
    "doc_registry": (doc_registry, DOC_REGISTRY),
    "registry_upsert": (registry_upsert, REGISTRY_UPSERT),
    "registry_batches": (registry_batches, REGISTRY_UPSERT),
    "verify_documents": (verify_documents, VERIFY_DOCUMENTS),
    "integrity_scan": (integrity_scan, INTEGRITY_SCAN),
    "integrity_failures": (integrity_failures, INTEGRITY_FAILURES),
    "unregistered_documents": (unregistered_documents, UNREGISTERED_DOCUMENTS),
    "missing_documents": (missing_documents, MISSING_DOCUMENTS),
    "hmac_verify": (hmac_verify, HMAC_VERIFY),
    "vector_baseline": (vector_baseline, VECTOR_BASELINE),
    "vector_norms": (vector_norms, VECTOR_NORMS),
    "vector_anomalies": (vector_anomalies, VECTOR_ANOMALIES),
    "vector_poisoning": (vector_poisoning, VECTOR_POISONING),
    "baseline_refresh": (baseline_refresh, BASELINE_REFRESH),
    "similar_documents": (similar_documents_query, SIMILAR_DOCUMENTS),
    "activation_ranks": (activation_ranks_query, ACTIVATION_RANKS),
    "similar_documents_join": (similar_documents_join, SIMILAR_DOCUMENTS_JOIN),
    "activation_check": (activation_check, ACTIVATION_CHECK),
    "array_stats": (array_stats, ARRAY_STATS),
}
