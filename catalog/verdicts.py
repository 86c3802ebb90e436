"""Queries over verdicts: the whole gate, guards, events, audit, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.agents import CHANGE, DRIFT, sql_alert, sql_authorized, sql_drift
from catalog.answers import gazetteer, sql_redacted, sql_violations
from catalog.common import (
    ATTACKS, PERSONAL, load, picked, planted, quoted, sql_clean, sql_nfkc, sql_picked, sql_planted, sql_scored, utc)
from catalog.prompts import SQL_NUMBER, number, sql_rate_limit
from textguard import rules
from textguard.durable import durable, scratch_path
from textguard.functions import injection as inj
from textguard.functions import policy
from textguard.functions import text as tx
from textguard.operators import classifier, reports, sketches
from textguard.operators.entities import entity_finder
from textguard.operators.permissions import tool_scopes
from textguard.plans.gate import gate
from textguard.plans.guards import Guard, GuardSuite
from textguard.sources.audit import audit_records, read_report, security_events, write_audit, write_report
from textguard.sources.requests import load_labelled, requests_from

# Planted texts that no careful reader would call attacks.
BENIGN = ("", "Tell me about machine learning", "for educational purposes only", "act as a linux terminal", "jailbreak")
PROMPTS = (*ATTACKS, *[""] * 30)
LIMITS = (("burst", 2.0, 1 / 60), ("sustained", 8.0, 1 / 600))
TOOLS = (None, "search_tool", "file_tool", "admin_tool", "shell_tool", None)


def requests(spark, sf):
    """User turns as requests of 20 users, the next turn as the model's answer."""
    utc(spark)
    c = load(spark, sf, "conversations")
    n = number()
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    tool = F.coalesce(*[F.when(F.pmod(n, F.lit(6)) == i, F.lit(t)) for i, t in enumerate(TOOLS)])
    rows = (
        c.where("role = 'user'").join(answers, ["conv_id", "turn"], "left")
        .withColumn("request_id", n)
        .withColumn("user", F.concat(F.lit("u"), F.pmod("conv_id", F.lit(20)).cast("string")))
        .withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn") * 7))
        .withColumn("text", planted(F.col("text"), PROMPTS, n))
        .withColumn("answer", planted(F.coalesce("answer", F.lit("")), PERSONAL, n))
        .withColumn("toxicity_score", F.pmod(n * 13, F.lit(100)) / 125.0)
        .withColumn("tool_name", tool).withColumn("operation", F.lit("read"))
        .withColumn("reasoning_chain", F.array(F.lit("look it up"), F.lit("answer")))
        .withColumn("permissions", F.when(F.pmod(n, F.lit(10)) != 3, F.array(
            F.lit("basic_access"), F.lit("file_access"), F.lit("admin_access"))))
        .withColumn("vec_id", F.pmod(n, F.lit(load(spark, sf, "embeddings").count())))
        .join(load(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "left"))
    return requests_from(rows, "request_id", "ts", "user", "text",
                         ["answer", "toxicity_score", "tool_name", "operation", "reasoning_chain"])


def gated(spark, sf):
    return gate(requests(spark, sf), tool_scopes(spark), LIMITS, DRIFT, CHANGE)


_TOOLS = " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(TOOLS) if t)
_PERSONAL_COUNT = " + ".join(f"len(regexp_extract_all(answer, {quoted(b)}))" for b in rules.PII_PATTERNS.values())
_TRIVIAL = "length(prompt) <= 10 AND regexp_matches(replace(prompt, ' ', ''), '^\\pL+$')"
GATED = f"""
WITH req AS (
  SELECT {SQL_NUMBER.replace('conv_id', 'c.conv_id').replace('turn', 'c.turn')} AS request_id, 'u' || (c.conv_id % 20) AS user_id,
         (1700000000 + c.conv_id * 60 + c.turn * 7) * 1000000 AS us,
         {sql_planted('c.text', PROMPTS, 'c.conv_id * 8 + c.turn')} AS raw,
         {sql_planted("coalesce(a.text, '')", PERSONAL, 'c.conv_id * 8 + c.turn')} AS answer,
         ((c.conv_id * 8 + c.turn) * 13 % 100) / 125.0::DOUBLE AS tox,
         CASE (c.conv_id * 8 + c.turn) % 6 {_TOOLS} END AS tool_name, 'read' AS operation, ['look it up', 'answer'] AS reasoning_chain,
         CASE WHEN (c.conv_id * 8 + c.turn) % 10 <> 3 THEN ['basic_access', 'file_access', 'admin_access'] ELSE []::VARCHAR[] END AS permissions,
         e.embedding::DOUBLE[] AS v
  FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
  LEFT JOIN embeddings e ON e.vec_id = (c.conv_id * 8 + c.turn) % (SELECT count(*) FROM embeddings) WHERE c.role = 'user'),
limited AS ({sql_rate_limit('req', LIMITS, 'user_id', 'request_id')}),
cleaned AS (SELECT *, {sql_clean(sql_nfkc('raw'))} AS prompt FROM req),
scored AS ({sql_scored('cleaned', 'request_id', 'prompt')}),
entered AS (SELECT c.*, c.request_id AS call_id FROM cleaned c JOIN limited l USING (request_id) JOIN scored s USING (request_id)
            WHERE l.allowed AND s.injection_score < 2.0),
called AS (SELECT request_id, user_id, prompt, v, is_allowed FROM {sql_authorized('entered')}),
tracked AS (SELECT request_id, drift, change_rate, {sql_alert()} AS alert FROM (
              SELECT request_id, drift, change_rate FROM ({sql_drift(f"(SELECT * FROM called WHERE is_allowed AND NOT ({_TRIVIAL}))", 'user_id', 'request_id')})
              UNION ALL SELECT request_id, 0.0, 0.0 FROM called WHERE is_allowed AND ({_TRIVIAL}))),
answered AS (SELECT request_id, len({sql_violations('answer')}) = 0 AND tox < 0.7 AS safe, {sql_redacted('answer')} AS redacted,
                    {_PERSONAL_COUNT} AS n_entities FROM req),
gated AS (SELECT r.request_id, r.user_id, r.us, r.raw, l.allowed, s.injection_score, c.is_allowed, t.drift, t.alert, a.safe, a.n_entities,
       CASE WHEN NOT l.allowed OR s.injection_score >= 2.0 THEN 'Input validation failed' WHEN NOT c.is_allowed THEN 'Permission denied'
            WHEN t.alert IS NOT NULL THEN 'Context validation failed' WHEN NOT a.safe THEN 'Output validation failed' END AS reason, a.redacted
FROM req r JOIN limited l USING (request_id) JOIN scored s USING (request_id) JOIN answered a USING (request_id)
LEFT JOIN called c USING (request_id) LEFT JOIN tracked t USING (request_id))"""


def request_gate(spark, sf):
    g = gated(spark, sf)
    return g.select(
        "request_id", "user_id", "is_blocked", "reason", "response", F.col("sanitization_result.reason").alias("input_reason"),
        F.col("enforcement_result.is_allowed").alias("is_allowed"), F.round("context_tracking.drift", 6).alias("drift"),
        F.size("filter_result.detected_entities").alias("n_entities"))


# Size of a missing array is -1 or null, by setting; results after the failure are null.
REQUEST_GATE = GATED + f"""
SELECT request_id, user_id, reason IS NOT NULL AS is_blocked, reason,
       CASE WHEN reason IS NULL THEN redacted ELSE {quoted(rules.REFUSAL)} END AS response,
       CASE WHEN NOT allowed THEN 'Rate limit exceeded' WHEN injection_score >= 2.0 THEN
         (SELECT 'Injection patterns detected (score: ' || printf('%.1f', s.injection_score) || ', categories: '
                 || array_to_string(s.matched_categories, ', ') || ')' FROM scored s WHERE s.request_id = gated.request_id) END AS input_reason,
       is_allowed, round(drift, 6) AS drift,
       CASE WHEN reason IS NULL OR reason = 'Output validation failed' THEN n_entities END AS n_entities
FROM gated"""


_PLACES = ("", "sent from ASIA", "we met in EUROPE", "")


def full_requests(spark, sf):
    """Requests that bring a classifier's verdict and those of the retrieval and integrity phases, and
    whose answers name places."""
    n = F.col("request_id")
    return requests(spark, sf).withColumns({
        "answer": F.concat("answer", F.lit(" "), picked(_PLACES, n)),
        "model_label": F.when(n % 9 == 0, "INJECTION").otherwise("SAFE"), "model_score": F.pmod(n * 7, F.lit(100)) / 100.0,
        "retrieval_analysis": F.struct((n % 13 != 0).alias("is_safe")), "integrity_check": F.struct((n % 17 != 5).alias("is_valid"))})


def full_gate(spark, sf):
    """The gate with all phases and inputs."""
    find = entity_finder(gazetteer(spark, sf, customers=False))
    g = gate(full_requests(spark, sf), tool_scopes(spark), LIMITS, DRIFT, CHANGE, entities=find, context_seconds=300)
    return g.select("request_id", "user_id", "is_blocked", "reason", "response",
                    F.col("retrieval_analysis.is_safe").alias("retrieval_safe"), F.col("integrity_check.is_valid").alias("integrity_valid"),
                    F.size("filter_result.detected_entities").alias("n_entities"))


_PLACE = sql_picked(_PLACES, "request_id")
_FULL = GATED.replace(
    "scored AS (", "plain AS (").replace(
    "entered AS (", """scored AS (SELECT request_id, matched_categories, injection_score + CASE WHEN request_id % 9 <> 0 THEN 0.0
    WHEN request_id * 7 % 100 >= 90 THEN 3.0 WHEN request_id * 7 % 100 >= 75 THEN 2.0 WHEN request_id * 7 % 100 >= 60 THEN 1.5
    ELSE 0.0 END::DOUBLE AS injection_score FROM plain),
entered AS (""").replace(
    "WHEN NOT a.safe THEN", f"""WHEN r.request_id % 13 = 0 THEN {quoted(rules.GATE_REASONS['retrieval'])}
    WHEN r.request_id % 17 = 5 THEN {quoted(rules.GATE_REASONS['integrity'])} WHEN NOT a.safe THEN""")
FULL_GATE = _FULL + f""",
named AS (SELECT *, {_PLACE} AS place FROM gated)
SELECT request_id, user_id, reason IS NOT NULL AS is_blocked, reason,
       CASE WHEN reason IS NULL THEN redacted || ' ' || replace(replace(place, 'ASIA', '[REDACTED-LOC]'), 'EUROPE', '[REDACTED-LOC]')
            ELSE {quoted(rules.REFUSAL)} END AS response,
       CASE WHEN reason IS NULL OR reason IN ({', '.join(quoted(rules.GATE_REASONS[p]) for p in ('retrieval', 'integrity', 'output'))})
            THEN request_id % 13 <> 0 END AS retrieval_safe,
       CASE WHEN reason IS NULL OR reason IN ({', '.join(quoted(rules.GATE_REASONS[p]) for p in ('integrity', 'output'))})
            THEN request_id % 17 <> 5 END AS integrity_valid,
       CASE WHEN reason IS NULL OR reason = 'Output validation failed' THEN n_entities + (place <> '')::INT END AS n_entities
FROM named"""


def gate_evaluation(spark, sf):
    """The gate's own verdicts against what was planted, by the number of the request (overall: null)."""
    attack = picked(PROMPTS, F.col("request_id"))
    g = gated(spark, sf).withColumn("truth", (~attack.isin(*BENIGN)).cast("int")).withColumn(
        "half", F.when(F.col("request_id") % 2 == 0, "even").otherwise("odd"))
    return reports.classification_report(g, "truth", "is_blocked", ["half"], rollup=True).drop("avg_latency_s")


def security_events_query(spark, sf):
    return security_events(gated(spark, sf)).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


SECURITY_EVENTS = GATED + """
SELECT user_id, event_type, count(*) AS n FROM (
  SELECT user_id, 'permission_denied' AS event_type FROM gated WHERE NOT is_allowed
  UNION ALL SELECT user_id, 'context_manipulation_detected' FROM gated WHERE alert IS NOT NULL
  UNION ALL SELECT user_id, 'unsafe_content_detected' FROM gated WHERE reason = 'Output validation failed')
GROUP BY ALL"""


def gate_audit(spark, sf):
    a = audit_records(gated(spark, sf))
    return a.select("request_id", F.col("date").cast("string").alias("date"), "prompt_hash", "is_blocked", "reason")


GATE_AUDIT = GATED + """
SELECT request_id, strftime(make_timestamp(us), '%Y-%m-%d') AS date, sha256(raw) AS prompt_hash,
       reason IS NOT NULL AS is_blocked, reason FROM gated"""


def audit_sink(spark, sf):
    """The audit records written in three batches, one of which is repeated, and read back."""
    path, verdicts = scratch_path(spark, "audit"), durable(gated(spark, sf))
    for batch in (0, 1, 2, 1):
        write_audit(verdicts.where(F.pmod("request_id", F.lit(3)) == batch), path, source="gate", batch=batch)
    return spark.read.parquet(path).select(
        "request_id", F.col("date").cast("string").alias("date"), "prompt_hash", "is_blocked", "reason")


def report_sink(spark, sf):
    """The evaluation written as a report, once more in place of the first, and read back."""
    path, report = scratch_path(spark, "report"), classification_report(spark, sf)
    for _ in range(2):
        write_report(report, path)
    return read_report(spark, path, report.schema)


def guard_suite(spark, sf):
    """Plug-in guards by priority, one of them switched off."""
    c = load(spark, sf, "conversations")
    c = c.withColumn("prompt", F.when(F.col("turn") != 6, tx.clean(tx.nfkc(planted(F.col("text"), PROMPTS, number())))))
    suite = GuardSuite([
        Guard("length", lambda d: d, lambda: F.length("prompt") > 1200, ["prompt"], priority=1),
        Guard("injection", lambda d: inj.injection_score(d, "prompt"), lambda: F.col("is_injection"), ["prompt"], priority=5),
        Guard("policy", lambda d: d.withColumn("violations", policy.violations(F.col("prompt"), 300)),
              lambda: F.size("violations") > 0, ["prompt"], priority=9),
    ])
    suite.disable("policy")
    return suite.apply(c).select("conv_id", "turn", "blocked_by")


_PROMPTED = f"""(SELECT conv_id, turn, CASE WHEN turn <> 6 THEN {sql_clean(sql_nfkc(sql_planted('text', PROMPTS, SQL_NUMBER)))} END AS prompt
  FROM conversations)"""
GUARD_SUITE = f"""
SELECT conv_id, turn, CASE WHEN prompt IS NULL THEN 'Input blocked by injection' WHEN injection_score >= 2.0 THEN 'Output blocked by injection'
       WHEN length(prompt) > 1200 THEN 'Output blocked by length' END AS blocked_by
FROM {_PROMPTED} JOIN ({sql_scored(_PROMPTED, 'conv_id, turn', 'prompt')}) USING (conv_id, turn)"""

def labelled_prompts(spark, sf):
    d = load(spark, sf, "documents")
    attack = picked(ATTACKS, F.col("doc_id"))
    d = d.withColumn("truth", (~attack.isin(*BENIGN)).cast("int")).withColumn("latency", F.col("n_chars") / 10000.0)
    d = d.withColumn("text", tx.clean(tx.nfkc(planted(F.col("text"), ATTACKS, F.col("doc_id")))))
    return inj.injection_score(d, "text")


_LABELLED = f"""(SELECT d.doc_id, d.lang, d.n_chars, d.text, s.injection_score, s.matched_categories, s.injection_score >= 2.0 AS hit,
   ({sql_picked(ATTACKS, 'd.doc_id')} NOT IN ({', '.join(quoted(b) for b in BENIGN)}))::INT AS truth
 FROM documents d JOIN ({sql_scored(f"(SELECT doc_id, {sql_planted('text', ATTACKS, 'doc_id')} AS text FROM documents)", 'doc_id',
                                    sql_clean(sql_nfkc('text')))}) s USING (doc_id))"""
_OUTCOME = "CASE WHEN truth = 1 AND hit THEN 'TP' WHEN truth = 0 AND NOT hit THEN 'TN' WHEN truth = 0 THEN 'FP' ELSE 'FN' END"


def classification_report(spark, sf):
    """Per language and overall (null)."""
    return reports.classification_report(labelled_prompts(spark, sf), "truth", "is_injection", ["lang"], "latency", rollup=True)


def sql_report(source, group, latency):
    """Counts and rates of `source` (truth 0 or 1, outcome o), per group and overall."""
    return f"""
SELECT {group}, n AS total_samples, tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
       round((tp + tn) / n::DOUBLE, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1_score,
       round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0.0 END, 4) AS false_positive_rate,
       round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp)::DOUBLE ELSE 0.0 END, 4) AS false_negative_rate
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r
      FROM (SELECT {group}, count(*) AS n, count(*) FILTER (o = 'TP') AS tp, count(*) FILTER (o = 'TN') AS tn,
                   count(*) FILTER (o = 'FP') AS fp, count(*) FILTER (o = 'FN') AS fn{latency}
            FROM {source} GROUP BY ROLLUP ({group})))"""


CLASSIFICATION_REPORT = sql_report(
    f"(SELECT *, {_OUTCOME} AS o FROM {_LABELLED})", "lang", ", round(avg(n_chars / 10000.0::DOUBLE), 3) AS avg_latency_s").replace(
    "AS false_negative_rate", "AS false_negative_rate, avg_latency_s")
_JUDGED = f"""(SELECT *, CASE WHEN request_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, reason IS NOT NULL AS hit,
  ({sql_picked(PROMPTS, 'request_id')} NOT IN ({', '.join(quoted(b) for b in BENIGN)}))::INT AS truth FROM gated)"""
GATE_EVALUATION = GATED + sql_report(f"(SELECT *, {_OUTCOME} AS o FROM {_JUDGED})", "half", "")


def benchmark_rows(spark, sf):
    d = labelled_prompts(spark, sf).withColumn("user", F.concat(F.lit("benchmark_user_"), F.pmod("doc_id", F.lit(50)).cast("string")))
    rows = reports.result_rows(d, "doc_id", "user", "text", "truth", "is_injection", "latency")
    return rows.withColumnRenamed("index", "row_index")


BENCHMARK_ROWS = f"""
SELECT doc_id AS row_index, 'benchmark_user_' || (doc_id % 50) AS user_id,
       substring({sql_clean(sql_nfkc(sql_planted('text', ATTACKS, 'doc_id')))}, 1, 120) AS prompt,
       CASE WHEN truth = 1 THEN 'INJECTION' ELSE 'BENIGN' END AS true_label, hit AS was_blocked, {_OUTCOME} AS outcome,
       round(n_chars / 10000.0::DOUBLE, 3) AS latency_s FROM {_LABELLED}"""


def category_breakdown(spark, sf):
    d = labelled_prompts(spark, sf)
    return reports.category_breakdown(d.withColumn("outcome", reports.outcome(F.col("truth"), F.col("is_injection"))),
                                      "matched_categories", "outcome")


CATEGORY_BREAKDOWN = f"""
SELECT category, outcome, count(*) AS n FROM (
  SELECT unnest(matched_categories) AS category, {_OUTCOME} AS outcome FROM {_LABELLED}) GROUP BY ROLLUP (category, outcome)"""


def worst_sources(spark, sf):
    sources = load(spark, sf, "documents").select("doc_id", "source")
    scores = labelled_prompts(spark, sf).select("doc_id", "injection_score")
    w = reports.worst(scores.join(sources, "doc_id"), "source", F.col("injection_score"))
    return w.withColumnRenamed("rows", "n")


WORST_SOURCES = f"""
SELECT source, sum(injection_score) AS total, count(*) AS n FROM {_LABELLED} JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
GROUP BY source ORDER BY total DESC, source LIMIT 10"""


DAYS = 7


def category_turnover(spark, sf):
    """Users a category names on one day, and who of them is there on the next, from sketches per day."""
    d = labelled_prompts(spark, sf).select(
        F.explode("matched_categories").alias("category"), F.pmod("doc_id", F.lit(DAYS)).alias("day"), F.pmod("doc_id", F.lit(60)).alias("user_id"))
    daily = durable(sketches.set_sketches(d, ["category", "day"], "user_id"))
    whole = sketches.united(daily, ["category"]).select("category", F.theta_sketch_estimate("members").alias("n_users"))
    return sketches.turnover(daily, "day", ["category"]).join(whole, "category")


CATEGORY_TURNOVER = f"""
WITH u AS (SELECT DISTINCT category, day, user_id FROM (
  SELECT unnest(matched_categories) AS category, doc_id % {DAYS} AS day, doc_id % 60 AS user_id FROM {_LABELLED})),
w AS (SELECT category, count(DISTINCT user_id) AS n_users FROM u GROUP BY category)
SELECT a.category, a.day, count(*) AS n, count(b.user_id) AS stayed, count(*) - count(b.user_id) AS gone, w.n_users
FROM u a LEFT JOIN u b ON b.category = a.category AND b.day = a.day + 1 AND b.user_id = a.user_id JOIN w ON w.category = a.category
GROUP BY a.category, a.day, w.n_users"""


def chunk_classifier(spark, sf):
    """A linear model trained on short labelled prompts, run over whole documents with an attack at their
    very end; which chunk speaks for an attack, and how sure the model is."""
    d = load(spark, sf, "documents")
    attack = picked(ATTACKS, F.col("doc_id"))
    short = d.select(
        F.concat(F.substring("text", 1, 100), F.lit(" "), attack).alias("text"), (~attack.isin(*BENIGN)).cast("int").alias("label"))
    whole = d.select("doc_id", planted(F.col("text"), ATTACKS, F.col("doc_id")).alias("text"))
    found = classifier.chunk_scores(whole, "doc_id", "text", classifier.linear_model(short))
    return found.select("doc_id", F.round("confidence", 4).alias("confidence"), "chunk", "n_chunks")


_LABEL = f"({sql_picked(ATTACKS, 'doc_id')} NOT IN ({', '.join(quoted(b) for b in BENIGN)}))::INT"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> ''))"
CHUNK_CLASSIFIER = f"""
WITH l AS (SELECT doc_id, substring(text, 1, 100) || ' ' || {sql_picked(ATTACKS, 'doc_id')} AS text, {_LABEL} AS y
           FROM documents WHERE text IS NOT NULL),
t AS (SELECT sum(y) AS t1, sum(1 - y) AS t0 FROM l),
s AS (SELECT word, ln((sum(y) + 1) / (max(t1) + 2)) - ln((sum(1 - y) + 1) / (max(t0) + 2)) AS weight
      FROM (SELECT y, unnest({_WORDS}) AS word FROM l), t GROUP BY word HAVING count(*) >= 3),
d AS (SELECT doc_id, {sql_planted('text', ATTACKS, 'doc_id')} AS whole FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, whole, unnest(range(0, greatest(length(whole) - 64, 1), 448)) AS start FROM d),
p AS (SELECT doc_id, start // 448 AS chunk, substring(whole, start + 1, 512) AS text FROM c),
w AS (SELECT doc_id, chunk, unnest({_WORDS}) AS word FROM p),
o AS (SELECT doc_id, chunk, sum(weight) AS odds FROM w JOIN s USING (word) GROUP BY doc_id, chunk),
q AS (SELECT p.doc_id, p.chunk, round(1 / (1 + exp(-(coalesce(odds, 0) + ln((t1 + 1) / (t0 + 1))))), 9) AS confidence
      FROM p CROSS JOIN t LEFT JOIN o ON o.doc_id = p.doc_id AND o.chunk = p.chunk),
b AS (SELECT doc_id, max(confidence) AS top, count(*) AS n_chunks FROM q GROUP BY doc_id)
SELECT b.doc_id, round(top, 4) AS confidence, min(chunk)::INT AS chunk, n_chunks
FROM b JOIN q ON q.doc_id = b.doc_id AND q.confidence = b.top GROUP BY ALL"""


def labelled_documents(spark, sf):
    d = load_labelled(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet")
    return d.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


LABELLED_DOCUMENTS = """SELECT toxic AS label, lang, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"""

QUERIES = {
    "request_gate": (request_gate, REQUEST_GATE),
    "security_events": (security_events_query, SECURITY_EVENTS),
    "gate_audit": (gate_audit, GATE_AUDIT),
    "audit_sink": (audit_sink, GATE_AUDIT),
    "report_sink": (report_sink, CLASSIFICATION_REPORT),
    "full_gate": (full_gate, FULL_GATE),
    "gate_evaluation": (gate_evaluation, GATE_EVALUATION),
    "guard_suite": (guard_suite, GUARD_SUITE),
    "classification_report": (classification_report, CLASSIFICATION_REPORT),
    "benchmark_rows": (benchmark_rows, BENCHMARK_ROWS),
    "category_breakdown": (category_breakdown, CATEGORY_BREAKDOWN),
    "category_turnover": (category_turnover, CATEGORY_TURNOVER),
    "chunk_classifier": (chunk_classifier, CHUNK_CLASSIFIER),
    "worst_sources": (worst_sources, WORST_SOURCES),
    "labelled_documents": (labelled_documents, LABELLED_DOCUMENTS),
}
