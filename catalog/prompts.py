"""Queries over prompts: cleaning, scoring, limits, input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    ATTACKS, CHARACTERS, SHORT, SPACE, THREATS, load, picked, planted, quoted, sql_clean, sql_nfkc, sql_picked,
    sql_planted, sql_scored, sql_strip, sql_words, utc)
from textguard import rules
from textguard.functions import injection as inj
from textguard.functions import text as tx
from textguard.functions import threats
from textguard.operators.agent_state import sequential_pattern
from textguard.operators.ratelimit import cooldown, rate_limit
from textguard.operators.sanitize import context_scores, context_similarity, sanitize
from textguard.sources.requests import assign_users, requests_from, split_valid

SQL_NUMBER = "conv_id * 8 + turn"
SLOW_LIMITS = (("burst", 3.0, 1 / 21600), ("sustained", 10.0, 1 / 86400))


def number():
    return F.col("conv_id") * 8 + F.col("turn")


def turns(spark, sf, literals):
    c = load(spark, sf, "conversations")
    return c.withColumn("text", planted(F.col("text"), literals, number()))


def sql_turns(literals):
    return f"(SELECT conv_id, turn, role, {sql_planted('text', literals, SQL_NUMBER)} AS text FROM conversations)"


def sanitize_text(spark, sf):
    cleaned = tx.clean(tx.nfkc(F.col("text")))
    return turns(spark, sf, CHARACTERS + ATTACKS).select("conv_id", "turn", cleaned.alias("clean_text"))


SANITIZE_TEXT = f"SELECT conv_id, turn, {sql_clean(sql_nfkc('text'))} AS clean_text FROM {sql_turns(CHARACTERS + ATTACKS)}"


def char_class_score(spark, sf):
    t = turns(spark, sf, CHARACTERS)
    return t.select("conv_id", "turn", F.round(tx.char_class_score(tx.nfkc(F.col("text"))), 6).alias("score"))


def sql_char_class(text):
    classes = [r"[\x00-\x1F\x7F-\x{9F}]", r"[\x{200B}-\x{200D}\x{FEFF}]",
               r"[\x{430}\x{435}\x{455}\x{456}\x{458}\x{440}\x{441}\x{501}-\x{505}]",
               r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", SPACE]
    return "(" + " + ".join(f"regexp_matches({text}, '{c}')::INT" for c in classes) + ") / 5.0::DOUBLE"


CHAR_CLASS_SCORE = (
    f"SELECT conv_id, turn, round({sql_char_class(sql_nfkc('text'))}, 6) AS score FROM {sql_turns(CHARACTERS)}")


def trivial_inputs(spark, sf):
    """Every turn once as it is and once replaced by a short answer."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    short = c.withColumn("text", picked(SHORT, number()))
    both = c.withColumn("is_short", F.lit(False)).unionByName(short.withColumn("is_short", F.lit(True)))
    return both.select("conv_id", "turn", "is_short", tx.is_trivial_prompt(F.col("text")).alias("trivial_prompt"),
                       tx.is_trivial_turn(F.col("text")).alias("trivial_turn"))


_STRIPPED = sql_strip("text")
TRIVIAL_INPUTS = f"""
SELECT conv_id, turn, is_short,
       length({_STRIPPED}) <= 10 AND regexp_matches({_STRIPPED}, '^(?:\\pL|{SPACE})*$') AS trivial_prompt,
       length({_STRIPPED}) <= 10 AND regexp_matches(replace({_STRIPPED}, ' ', ''), '^\\pL+$') AS trivial_turn
FROM (SELECT conv_id, turn, text, false AS is_short FROM conversations
      UNION ALL SELECT conv_id, turn, {sql_picked(SHORT, SQL_NUMBER)}, true FROM conversations)"""


def scored_turns(spark, sf):
    t = turns(spark, sf, ATTACKS).withColumn("text", tx.clean(tx.nfkc(F.col("text"))))
    return inj.injection_score(t, "text")


def injection_score(spark, sf):
    return scored_turns(spark, sf).select(
        "conv_id", "turn", "injection_score", F.array_join("matched_categories", ",").alias("categories"), "is_injection")


SCORED = sql_scored(sql_turns(ATTACKS), "conv_id, turn", sql_clean(sql_nfkc("text")))
INJECTION_SCORE = f"""
SELECT conv_id, turn, injection_score, array_to_string(matched_categories, ',') AS categories,
       injection_score >= 2.0 AS is_injection FROM ({SCORED})"""


def injection_by_category(spark, sf):
    return (scored_turns(spark, sf).select(F.explode("matched_categories").alias("category"), "is_injection")
            .groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_injection").alias("n_blocked")))


INJECTION_BY_CATEGORY = f"""
SELECT category, count(*) AS n, count(*) FILTER (injection_score >= 2.0) AS n_blocked
FROM (SELECT unnest(matched_categories) AS category, injection_score FROM ({SCORED})) GROUP BY category"""


def document_injection(spark, sf):
    """Whole documents, for instructions hidden in a corpus."""
    d = load(spark, sf, "documents")
    d = d.withColumn("text", tx.clean(tx.nfkc(planted(F.col("text"), ATTACKS, F.col("doc_id")))))
    return inj.injection_score(d, "text").select(
        "doc_id", "injection_score", F.array_join("matched_categories", ",").alias("categories"))


_DOCS = f"(SELECT doc_id, {sql_planted('text', ATTACKS, 'doc_id')} AS text FROM documents)"
DOCUMENT_INJECTION = f"""
SELECT doc_id, injection_score, array_to_string(matched_categories, ',') AS categories
FROM ({sql_scored(_DOCS, 'doc_id', sql_clean(sql_nfkc('text')))})"""


def model_score_bands(spark, sf):
    """Rule scores joined by a classifier's verdict, here made up from the row number."""
    t = scored_turns(spark, sf)
    t = (t.withColumn("label", F.when(F.pmod(number(), F.lit(3)) == 0, "injection").otherwise("LEGIT"))
         .withColumn("confidence", F.pmod(number() * 7, F.lit(100)) / 100.0))
    return inj.add_model_score(t, "label", "confidence").select(
        "conv_id", "turn", "injection_score", F.array_join("matched_categories", ",").alias("categories"), "is_injection",
        F.round(inj.prompt_risk(F.col("injection_score")), 6).alias("risk"))


MODEL_SCORE_BANDS = f"""
SELECT conv_id, turn, total AS injection_score,
       array_to_string(CASE WHEN says AND total >= 2.0 THEN list_append(matched_categories, 'ml_classifier')
                            ELSE matched_categories END, ',') AS categories,
       total >= 2.0 AS is_injection, round(least(total / 3.0::DOUBLE, 1.0), 6) AS risk
FROM (SELECT *, injection_score + CASE WHEN NOT says THEN 0.0 WHEN c >= 0.9 THEN 3.0 WHEN c >= 0.75 THEN 2.0
                                       WHEN c >= 0.6 THEN 1.5 ELSE 0.0 END::DOUBLE AS total
      FROM (SELECT *, ({SQL_NUMBER}) % 3 = 0 AS says, ((({SQL_NUMBER}) * 7) % 100) / 100.0::DOUBLE AS c
            FROM ({SCORED})))"""


def timed_turns(spark, sf, literals):
    """Turns of a conversation a minute apart, with a longer pause every third turn."""
    t = turns(spark, sf, literals)
    seconds = F.col("turn") * 60 + F.floor(F.col("turn") / 3) * 240
    return t.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + seconds)).withColumn("request_id", number())


SQL_SECONDS = "(turn * 60 + (turn // 3) * 240)"


def context_similarity_query(spark, sf):
    t = timed_turns(spark, sf, ATTACKS)
    scores = context_scores(t, "conv_id", "ts", "request_id", "text")
    return scores.select("conv_id", (F.col("request_id") - F.col("conv_id") * 8).alias("turn"), F.round("context_score", 6).alias("context_score"))


def sql_context(text, source):
    recent = ", ".join(
        f"CASE WHEN s - lag(s, {i}) OVER w < 300 THEN lag(words, {i}) OVER w ELSE [] END" for i in (1, 2, 3))
    return f"""
SELECT conv_id, turn, CASE WHEN len(recent) = 0 THEN 0.0 ELSE
         len(list_intersect(words, recent)) / len(list_distinct(list_concat(words, recent)))::DOUBLE END AS context_score
FROM (SELECT conv_id, turn, words, list_distinct(flatten([{recent}])) AS recent
      FROM (SELECT conv_id, turn, {SQL_SECONDS} AS s, list_distinct({sql_words(text)}) AS words FROM {source})
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


CONTEXT_SIMILARITY = f"""SELECT conv_id, turn, round(context_score, 6) AS context_score
FROM ({sql_context('text', sql_turns(ATTACKS))})"""


def sequential_pattern_query(spark, sf):
    """Inputs that repeat the user's recent ones: each conversation repeats its attack."""
    t = timed_turns(spark, sf, ("",)).withColumn(
        "text", F.when(F.col("turn") % 3 == 2, picked(ATTACKS, F.col("conv_id"))).otherwise(
            F.concat(picked(ATTACKS, F.col("conv_id")), F.lit(" "), F.col("turn").cast("string"))))
    scored = context_similarity(t, "conv_id", "ts", "request_id", "text")
    return sequential_pattern(scored, "context_score", rules.SEQUENTIAL_SIMILARITY).select(
        "conv_id", "turn", "sequential_pattern")


_REPEATED = f"""(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN {sql_picked(ATTACKS, 'conv_id')}
   ELSE {sql_picked(ATTACKS, 'conv_id')} || ' ' || turn END AS text FROM conversations)"""
SEQUENTIAL_PATTERN = f"""SELECT conv_id, turn, context_score >= 0.5 AS sequential_pattern
FROM ({sql_context('text', _REPEATED)})"""


def sanitization_verdict(spark, sf):
    """The whole first guard: layers, exit probability, score, reason."""
    t = context_similarity(timed_turns(spark, sf, ATTACKS), "conv_id", "ts", "request_id", "text")
    vectors = load(spark, sf, "embeddings").select("vec_id", "embedding")
    t = t.withColumn("vec_id", F.pmod(number(), F.lit(vectors.count()))).join(vectors, "vec_id", "left")
    s = sanitize(t, "text", F.col("context_score"), F.transform("embedding", lambda x: x * 100))
    r = F.col("sanitization_result")
    return s.select(
        "conv_id", "turn", r["is_safe"].alias("is_safe"), F.round(r["exit_probability"], 6).alias("exit_probability"),
        F.round(r["mahalanobis_score"], 4).alias("mahalanobis_score"), r["reason"].alias("reason"))


SANITIZATION_VERDICT = f"""
WITH t AS (SELECT *, {sql_nfkc('text')} AS n FROM {sql_turns(ATTACKS)}),
c AS ({sql_context('text', sql_turns(ATTACKS))}),
s AS ({SCORED}),
l AS (SELECT t.conv_id, t.turn, s.injection_score, s.matched_categories,
             length({sql_strip('n')}) <= 10 AND regexp_matches({sql_strip('n')}, '^(?:\\pL|{SPACE})*$') AS trivial,
             {sql_char_class('n')} AS l1, c.context_score AS l2,
             least(list_sum(list_transform(e.embedding, lambda x: pow(0.01::DOUBLE * (x * 100::FLOAT)::DOUBLE, 2))), 5.0) AS l3
      FROM t JOIN c ON t.conv_id = c.conv_id AND t.turn = c.turn JOIN s ON t.conv_id = s.conv_id AND t.turn = s.turn
      LEFT JOIN embeddings e ON e.vec_id = (t.conv_id * 8 + t.turn) % (SELECT count(*) FROM embeddings))
SELECT conv_id, turn, injection_score < 2.0 AS is_safe,
       round(1 / (1 + exp(-0.5::DOUBLE * ((CASE WHEN trivial THEN 0.0 ELSE greatest(l1, l2, l3) END) - 0.99::DOUBLE))), 6) AS exit_probability,
       round(CASE WHEN trivial THEN 0.0 ELSE l3 END, 4) AS mahalanobis_score,
       CASE WHEN injection_score >= 2.0 THEN 'Injection patterns detected (score: ' || printf('%.1f', injection_score)
            || ', categories: ' || array_to_string(matched_categories, ', ') || ')' END AS reason
FROM l"""


def text_chunks(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(tx.chunks(F.col("text"))).alias("chunk_no", "chunk")).select(
        "doc_id", "chunk_no", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("chunk_hash"))


TEXT_CHUNKS = """
SELECT doc_id, i AS chunk_no, length(substring(text, i * 1000 + 1, 1000)) AS chars,
       sha256(substring(text, i * 1000 + 1, 1000)) AS chunk_hash
FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + 999) // 1000, 1))) AS i FROM documents)"""


def prompt_prefixes(spark, sf):
    """What a bounded classifier sees and what reports show, of prompts kept whole."""
    c = load(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.length("text").alias("chars"),
        F.sha2(tx.prefix(F.col("text"), rules.CLASSIFIER_CHARS), 256).alias("classifier_hash"),
        tx.prefix(F.col("text"), rules.REPORT_CHARS).alias("shown"))


PROMPT_PREFIXES = """SELECT conv_id, turn, length(text) AS chars, sha256(substring(text, 1, 512)) AS classifier_hash,
    substring(text, 1, 120) AS shown FROM conversations"""


def rate_limit_query(spark, sf):
    utc(spark)
    return rate_limit(load(spark, sf, "events"), "user_id", "ts", "event_id", SLOW_LIMITS).select(
        "user_id", "event_id", "allowed", F.round("burst_tokens", 6).alias("burst_tokens"),
        F.round("sustained_tokens", 6).alias("sustained_tokens"))


def sql_rate_limit(source, limits, key="user_id", row_id="event_id"):
    """Token buckets as a recursion over each key's requests.  `source` gives
    `us` (microseconds)."""
    (_, b_cap, b_rate), (_, s_cap, s_rate) = limits
    rate = [f"(1.0::DOUBLE / {round(1 / r)})" for r in (b_rate, s_rate)]
    return f"""
WITH RECURSIVE e AS (
  SELECT {key} AS k, {row_id} AS id, us, row_number() OVER (PARTITION BY {key} ORDER BY us, {row_id}) AS rn FROM {source}),
r AS (
  SELECT k, id, us, rn, true AS allowed, {b_cap}::DOUBLE - 1.0 AS b, {s_cap}::DOUBLE - 1.0 AS s, us AS s_us FROM e WHERE rn = 1
  UNION ALL
  SELECT k, id, us, rn, b >= 1.0 AND s >= 1.0, CASE WHEN b >= 1.0 THEN b - 1.0 ELSE b END,
         CASE WHEN b < 1.0 THEN old_s WHEN s >= 1.0 THEN s - 1.0 ELSE s END, CASE WHEN b < 1.0 THEN old_us ELSE us END
  FROM (SELECT e.k, e.id, e.us, e.rn, r.s AS old_s, r.s_us AS old_us,
               least({b_cap}::DOUBLE, r.b + (e.us - r.us) / 1e6::DOUBLE * {rate[0]}) AS b,
               least({s_cap}::DOUBLE, r.s + (e.us - r.s_us) / 1e6::DOUBLE * {rate[1]}) AS s
        FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1))
SELECT k AS {key}, id AS {row_id}, allowed, round(b, 6) AS burst_tokens, round(s, 6) AS sustained_tokens FROM r"""


_EVENTS = "(SELECT *, epoch_us(ts) AS us FROM events)"
RATE_LIMIT = sql_rate_limit(_EVENTS, SLOW_LIMITS)


def alert_cooldown(spark, sf):
    """Every event as an alert; at most one per user and day fires."""
    utc(spark)
    return cooldown(load(spark, sf, "events"), "user_id", "ts", "event_id", 86400.0).select("user_id", "event_id", "fires")


ALERT_COOLDOWN = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM {_EVENTS}),
r AS (
  SELECT user_id, event_id, us AS last, rn, true AS fires FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, CASE WHEN e.us - r.last >= 86400000000 THEN e.us ELSE r.last END, e.rn,
         e.us - r.last >= 86400000000
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, fires FROM r"""


def input_threats(spark, sf):
    t = turns(spark, sf, THREATS)
    text = F.col("text")
    return t.select(
        "conv_id", "turn", threats.length_exceeded(text, 1500).alias("length_exceeded"),
        F.array_join(threats.malicious_patterns(text), ",").alias("malicious"),
        F.array_join(threats.character_threats(text), ",").alias("characters"),
        threats.repetition(text).alias("repetition"), threats.has_homoglyph(text).alias("homoglyph"))


def _flags(table, prefix=""):
    cases = ", ".join(f"CASE WHEN regexp_matches(text, {quoted(prefix + body)}) THEN {quoted(name)} END" for name, body in table)
    return f"coalesce(array_to_string([{cases}], ','), '')"


_CHARS = (("rtl_override", r"\x{202E}"), ("escaped_null", r"\\u0000"), ("zero_width", r"[\x{200B}-\x{200D}\x{FEFF}]"))
# RE2 has no back-references: runs are found by comparing each character with the one before.
INPUT_THREATS = f"""
WITH t AS (SELECT * FROM {sql_turns(THREATS)}),
tokens AS (SELECT conv_id, turn, count(*) AS n, max(c) AS top, sum(c) AS total
           FROM (SELECT conv_id, turn, tok, count(*) AS c
                 FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS tok FROM t)
                 GROUP BY ALL) GROUP BY ALL),
chars AS (SELECT conv_id, turn, i, ch, sum(change) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
          FROM (SELECT conv_id, turn, i, ch,
                       CASE WHEN ch = lag(ch) OVER (PARTITION BY conv_id, turn ORDER BY i) THEN 0 ELSE 1 END AS change
                FROM (SELECT conv_id, turn, unnest(range(1, length(text) + 1)) AS i,
                             unnest(string_split(text, '')) AS ch FROM t))),
runs AS (SELECT conv_id, turn, max(n) AS longest FROM (
           SELECT conv_id, turn, run, count(*) AS n FROM chars WHERE NOT regexp_matches(ch, '\\s') GROUP BY ALL) GROUP BY ALL)
SELECT t.conv_id, t.turn, length(text) > 1500 AS length_exceeded, {_flags(rules.MALICIOUS_PATTERNS, '(?i)')} AS malicious,
       {_flags(_CHARS)} AS characters,
       coalesce(longest >= 50, false) OR coalesce(total >= 10 AND top / total::DOUBLE >= 0.5, false) AS repetition,
       regexp_matches(text, '[\\x{{430}}\\x{{435}}\\x{{455}}\\x{{456}}\\x{{458}}\\x{{440}}\\x{{441}}\\x{{501}}-\\x{{505}}]') AS homoglyph
FROM t LEFT JOIN tokens USING (conv_id, turn) LEFT JOIN runs USING (conv_id, turn)"""


def homograph_words(spark, sf):
    t = turns(spark, sf, THREATS)
    return t.select("conv_id", "turn", F.explode(threats.mixed_script_words(F.col("text"))).alias("word"))


HOMOGRAPH_WORDS = f"""
SELECT conv_id, turn, word FROM (
  SELECT conv_id, turn, unnest(string_split_regex(text, '[^\\pL\\pN.\\-]+')) AS word FROM {sql_turns(THREATS)})
WHERE regexp_matches(word, '\\p{{Latin}}') AND regexp_matches(word, '\\p{{Cyrillic}}')"""


def context_warnings(spark, sf):
    stamps = ("2024-01-01 10:00:00", "invalid", "1693276800", "2024-13-45")
    c = load(spark, sf, "conversations")
    user = F.when(F.col("conv_id") % 4 != 0, F.col("conv_id").cast("string"))
    stamp = F.when(F.col("turn") != 5, picked(stamps, F.col("turn")))
    return c.select("conv_id", "turn", F.array_join(threats.context_warnings(user, stamp), ",").alias("warnings"))


CONTEXT_WARNINGS = """
SELECT conv_id, turn, coalesce(array_to_string([CASE WHEN conv_id % 4 = 0 THEN 'missing_user' END,
    CASE WHEN turn = 5 THEN 'missing_timestamp' END,
    CASE WHEN turn <> 5 AND turn % 4 IN (1, 3) THEN 'invalid_timestamp' END], ','), '') AS warnings FROM conversations"""


def valid_requests(spark, sf):
    """Rows that lack a required field are set aside with what they lack."""
    c = load(spark, sf, "conversations").withColumn("request_id", number())
    c = (c.withColumn("user", F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("u"), F.col("conv_id").cast("string"))))
         .withColumn("text", F.when(F.col("turn") != 3, F.col("text")))
         .withColumn("ts", F.timestamp_seconds(F.col("request_id"))))
    requests = requests_from(c, "request_id", "ts", "user", "text")
    valid, rejected = split_valid(requests, ["prompt", "user_id"])
    shape = ["request_id", "user_id", "risk_level", F.size("permissions").alias("n_permissions")]
    return valid.select(*shape, F.lit("").alias("missing")).unionByName(
        rejected.select(*shape, F.array_join("missing", ",").alias("missing")))


VALID_REQUESTS = f"""
SELECT {SQL_NUMBER} AS request_id, CASE WHEN conv_id % 5 <> 0 THEN 'u' || conv_id ELSE 'anonymous' END AS user_id,
       0.0::DOUBLE AS risk_level, 0 AS n_permissions, CASE WHEN turn = 3 THEN 'prompt' ELSE '' END AS missing
FROM conversations"""


def assigned_users(spark, sf):
    return assign_users(load(spark, sf, "documents").select("doc_id"), "doc_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


ASSIGNED_USERS = """SELECT 'benchmark_user_' || (doc_id % 50) AS user_id, count(*) AS n, min(doc_id) AS first_doc
FROM documents GROUP BY 1"""

QUERIES = {
    "sanitize_text": (sanitize_text, SANITIZE_TEXT),
    "char_class_score": (char_class_score, CHAR_CLASS_SCORE),
    "trivial_inputs": (trivial_inputs, TRIVIAL_INPUTS),
    "injection_score": (injection_score, INJECTION_SCORE),
    "injection_by_category": (injection_by_category, INJECTION_BY_CATEGORY),
    "document_injection": (document_injection, DOCUMENT_INJECTION),
    "model_score_bands": (model_score_bands, MODEL_SCORE_BANDS),
    "context_similarity": (context_similarity_query, CONTEXT_SIMILARITY),
    "sequential_pattern": (sequential_pattern_query, SEQUENTIAL_PATTERN),
    "sanitization_verdict": (sanitization_verdict, SANITIZATION_VERDICT),
    "text_chunks": (text_chunks, TEXT_CHUNKS),
    "prompt_prefixes": (prompt_prefixes, PROMPT_PREFIXES),
    "rate_limit": (rate_limit_query, RATE_LIMIT),
    "alert_cooldown": (alert_cooldown, ALERT_COOLDOWN),
    "input_threats": (input_threats, INPUT_THREATS),
    "homograph_words": (homograph_words, HOMOGRAPH_WORDS),
    "context_warnings": (context_warnings, CONTEXT_WARNINGS),
    "valid_requests": (valid_requests, VALID_REQUESTS),
    "assigned_users": (assigned_users, ASSIGNED_USERS),
}
