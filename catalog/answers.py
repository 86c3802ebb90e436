"""Queries over answers and documents: personal data, policy, entities, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import PERSONAL, load, picked, planted, quoted, sql_picked, sql_planted, sql_words, utc
from catalog.prompts import SQL_NUMBER, number
from textguard import rules
from textguard.functions import pii, policy
from textguard.functions import vectors as vec
from textguard.operators import retrieval as ret
from textguard.operators.entities import dictionary_entities, entity_finder
from textguard.operators.output import dictionary_keywords, filter_text
from textguard.operators.toxicity import text_embedding, toxicity_score, train_toxicity, word_odds_score, word_weights

_DOCS = f"(SELECT doc_id, {sql_planted('text', PERSONAL, 'doc_id')} AS text FROM documents)"


def documents(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return d.withColumn("text", planted(F.col("text"), PERSONAL, F.col("doc_id")))


def pii_spans(spark, sf):
    found = pii.span_rows(documents(spark, sf), "doc_id", pii.pii_spans(F.col("text")))
    return found.withColumnsRenamed({"start": "start_at", "end": "end_at"})


def _sql_spans(kind, body):
    # Unicode word edges: a letter beyond ASCII next to a digit is no edge.
    return f"""
SELECT doc_id, {quoted(kind)} AS type, m AS text, pos AS start_at, pos + length(m) AS end_at, 1.0::DOUBLE AS confidence
FROM (SELECT doc_id, found[i] AS m, coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0)
             + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0) AS pos
      FROM (SELECT doc_id, found, pieces, unnest(range(1, len(found) + 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, {quoted(body)}) AS found,
                         string_split_regex(text, {quoted(body)}) AS pieces FROM {_DOCS})))"""


PII_SPANS = " UNION ALL ".join(_sql_spans(k, b) for k, b in rules.PII_PATTERNS.items())


def pii_redact(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(pii.redact_pii(F.col("text")), 256).alias("redacted_hash"),
                                       F.length(pii.redact_pii(F.col("text"))).alias("chars"))


def sql_redacted(text):
    for kind, body in rules.PII_PATTERNS.items():
        text = f"regexp_replace({text}, {quoted(body)}, '[REDACTED-{kind}]', 'g')"
    return text


PII_REDACT = f"""SELECT doc_id, sha256(r) AS redacted_hash, length(r) AS chars
FROM (SELECT doc_id, {sql_redacted('text')} AS r FROM {_DOCS})"""


def pii_redact_spans(spark, sf):
    """Redaction by offsets, right to left, on answers."""
    t = answers(spark, sf)
    spans = pii.pii_spans(F.col("text"))
    return t.select("conv_id", "turn", pii.redact_spans(F.col("text"), spans).alias("redacted"))


def answers(spark, sf):
    c = load(spark, sf, "conversations")
    return c.withColumn("text", planted(F.col("text"), PERSONAL, number()))


_ANSWERS = f"(SELECT conv_id, turn, {sql_planted('text', PERSONAL, SQL_NUMBER)} AS text FROM conversations)"
PII_REDACT_SPANS = f"SELECT conv_id, turn, {sql_redacted('text')} AS redacted FROM {_ANSWERS}"


def policy_check(spark, sf):
    d = documents(spark, sf).withColumn("v", policy.violations(F.col("text")))
    return d.select("doc_id", F.array_join("v", "; ").alias("violations"))


def _sql_found(words, dictionary):
    return f"list_sort(list_intersect({words}, [{', '.join(quoted(w) for w in dictionary)}]))"


def sql_violations(text, length="2000"):
    words = sql_words(text)
    restricted, black = _sql_found(words, rules.RESTRICTED_KEYWORDS), _sql_found(words, rules.BLACKLISTED_KEYWORDS)
    return f"""list_filter([CASE WHEN length({text}) > {length} THEN 'Exceeds maximum length' END,
      CASE WHEN len({restricted}) > 0 THEN 'Contains restricted keywords: ' || array_to_string({restricted}, ', ') END,
      CASE WHEN len({black}) > 0 THEN 'Contains blacklisted content: ' || array_to_string({black}, ', ') END],
      lambda x: x IS NOT NULL)"""


POLICY_CHECK = f"SELECT doc_id, coalesce(array_to_string({sql_violations('text')}, '; '), '') AS violations FROM {_DOCS}"


def dictionary_keywords_query(spark, sf):
    """The keyword lists as a table, and the source names as a third list."""
    lists = [(w, "restricted") for w in rules.RESTRICTED_KEYWORDS] + [(w, "blacklist") for w in rules.BLACKLISTED_KEYWORDS]
    table = spark.createDataFrame(lists, "keyword string, list string").unionByName(
        load(spark, sf, "documents").select(F.lower("lang").alias("keyword"), F.lit("language").alias("list")).distinct())
    found = dictionary_keywords(documents(spark, sf), "doc_id", "text", table)
    return found.select("doc_id", "list", F.array_join("keywords", ",").alias("keywords"))


_LISTS = ", ".join(f"({quoted(w)}, 'restricted')" for w in rules.RESTRICTED_KEYWORDS) + ", " + ", ".join(
    f"({quoted(w)}, 'blacklist')" for w in rules.BLACKLISTED_KEYWORDS)
DICTIONARY_KEYWORDS = f"""
WITH k AS (SELECT * FROM (VALUES {_LISTS}) AS t(keyword, list) UNION SELECT DISTINCT lower(lang), 'language' FROM documents),
w AS (SELECT DISTINCT doc_id, unnest({sql_words('text')}) AS keyword FROM {_DOCS})
SELECT doc_id, list, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM w JOIN k USING (keyword) GROUP BY doc_id, list"""


def toxicity_stand_in(row):
    return F.pmod(row * 13, F.lit(100)) / 100.0


def output_filter(spark, sf):
    t = answers(spark, sf)
    f = filter_text(t, "text", toxicity_stand_in(number()))
    r = F.col("filter_result")
    return f.select(
        "conv_id", "turn", "text", r["is_safe"].alias("is_safe"), r["filtered_text"].alias("filtered_text"),
        F.size(r["detected_entities"]).alias("n_entities"), F.size(r["policy_violations"]).alias("n_violations"),
        F.round(r["confidence"], 6).alias("confidence"))


_COUNTS = " + ".join(f"len(regexp_extract_all(text, {quoted(b)}))" for b in rules.PII_PATTERNS.values())
OUTPUT_FILTER = f"""
SELECT conv_id, turn, CASE WHEN safe THEN text ELSE {quoted(rules.HARM_REFUSAL)} END AS text, safe AS is_safe,
       CASE WHEN safe THEN redacted ELSE {quoted(rules.HARM_REFUSAL)} END AS filtered_text, n_entities, n_violations,
       round(1.0 - (0.3 * (n_entities > 0)::INT + 0.3 * (n_violations > 0)::INT + 0.4 * (tox > 0.5)::INT)::DOUBLE, 6) AS confidence
FROM (SELECT *, n_violations = 0 AND tox < 0.7 AS safe
      FROM (SELECT conv_id, turn, text, {sql_redacted('text')} AS redacted, {_COUNTS} AS n_entities,
                   len({sql_violations('text')}) AS n_violations, ((({SQL_NUMBER}) * 13) % 100) / 100.0::DOUBLE AS tox
            FROM {_ANSWERS}))"""


def missing_disclaimers(spark, sf):
    endings = ("", *rules.REQUIRED_DISCLAIMERS, " ".join(rules.REQUIRED_DISCLAIMERS))
    c = load(spark, sf, "conversations").where("role = 'assistant'")
    t = c.withColumn("text", planted(F.col("text"), endings, F.col("conv_id")))
    return t.select("conv_id", "turn", F.size(policy.missing_disclaimers(F.col("text"))).alias("n_missing"))


MISSING_DISCLAIMERS = """SELECT conv_id, turn, [2, 1, 1, 0][(conv_id % 4) + 1] AS n_missing
FROM conversations WHERE role = 'assistant'"""


# Names are planted into every document: a country, a region, a customer.
def named_documents(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    regions = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    customer = F.format_string("%09d", F.pmod("doc_id", F.lit(100)))
    return d.withColumn("text", F.concat_ws(
        " ", "text", F.concat(F.lit("from NATION_"), F.pmod("doc_id", F.lit(30)).cast("string")),
        F.concat(F.lit("("), picked(regions, F.col("doc_id")), F.lit(")")), F.concat(F.lit("Customer#"), customer)))


_NAMED = f"""(SELECT doc_id, text || ' from NATION_' || (doc_id % 30) || ' (' || {sql_picked(
    ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'), 'doc_id')} || ') Customer#' || printf('%09d', doc_id % 100)
    AS text, length(text) AS base FROM documents)"""


def gazetteer(spark, sf, customers):
    names = (
        load(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("GPE").alias("type"))
        .unionByName(load(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("LOC").alias("type"))))
    if customers:
        names = names.unionByName(
            load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("PERSON").alias("type")))
    return names


def entity_spans(spark, sf):
    find = entity_finder(gazetteer(spark, sf, customers=False))
    found = pii.span_rows(named_documents(spark, sf), "doc_id", find("text"))
    return found.withColumnsRenamed({"start": "start_at", "end": "end_at"}).drop("confidence")


# The planted tail is the only place with names, so SQL can work out the offsets.
_ENTITIES = f"""
SELECT doc_id, type, name AS text, CAST(pos - 1 AS BIGINT) AS start_at, CAST(pos - 1 + length(name) AS BIGINT) AS end_at
FROM (SELECT d.doc_id, g.type, g.name, base + strpos(substring(d.text, base + 1), g.name) AS pos, d.text
      FROM {_NAMED} d JOIN (SELECT n_name AS name, 'GPE' AS type FROM nation
                            UNION ALL SELECT r_name, 'LOC' FROM region {{customers}}) g
      ON contains(substring(d.text, base + 1), g.name))
WHERE NOT regexp_matches(substring(text, CAST(pos + length(name) AS BIGINT), 1), '[0-9]')"""
ENTITY_SPANS = _ENTITIES.format(customers="")


def dictionary_entities_query(spark, sf):
    """The same with the customers as well, joined as a table of any size."""
    found = dictionary_entities(named_documents(spark, sf), "doc_id", "text", gazetteer(spark, sf, customers=True))
    return found.select("doc_id", "type", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


DICTIONARY_ENTITIES = _ENTITIES.format(customers="UNION ALL SELECT c_name, 'PERSON' FROM customer")


def toxicity(spark, sf):
    """Scores of all documents by the words of the labelled ones."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    labels = load(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    scores = word_odds_score(d, word_weights(d.join(labels, "doc_id")), "doc_id")
    return scores.select("doc_id", F.round("toxicity_score", 4).alias("toxicity_score"))


TOXICITY = r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '')) AS word
           FROM documents WHERE text IS NOT NULL),
t AS (SELECT sum(toxic) AS t1, sum(1 - toxic) AS t0 FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
c AS (SELECT word, sum(toxic) AS n1, sum(1 - toxic) AS n0 FROM w JOIN labels USING (doc_id) GROUP BY word HAVING count(*) >= 3),
s AS (SELECT word, ln((n1 + 1) / (t1 + 2)) - ln((n0 + 1) / (t0 + 2)) AS weight FROM c, t),
o AS (SELECT doc_id, sum(weight) AS odds FROM w JOIN s USING (word) GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN d.text IS NULL THEN 0.0
  ELSE 1 / (1 + exp(-(coalesce(o.odds, 0) + ln((t1 + 1) / (t0 + 1))))) END, 4)::DOUBLE AS toxicity_score
FROM documents d CROSS JOIN t LEFT JOIN o ON o.doc_id = d.doc_id"""


def toxicity_model(spark, sf):
    """Scores of all documents by a logistic regression trained on the labelled ones."""
    d = load(spark, sf, "documents").select("doc_id", "text")
    labels = load(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(d.join(labels, "doc_id"))
    return toxicity_score(d, model).select("doc_id", F.round("toxicity_score", 4).alias("toxicity_score"))


def text_embedding_query(spark, sf):
    """Hashed word counts as unit vectors, for tables without embeddings."""
    e = text_embedding(load(spark, sf, "conversations"))
    return e.select("conv_id", "turn", F.size("embedding").alias("dim"),
                    F.round(vec.norm(F.col("embedding")), 6).alias("length"))


TEXT_EMBEDDING = "SELECT conv_id, turn, 64 AS dim, 1.0::DOUBLE AS length FROM conversations"


KNOWN = ("the", "and", "of", "in", "de", "la", "die", "und", "who", "is")


def known_word_embedding(spark, sf):
    """Counts of known words as unit vectors, the vectors written out."""
    e = text_embedding(load(spark, sf, "conversations"), vocabulary=KNOWN)
    parts = F.transform("embedding", lambda x: F.round(x, 4).cast("string"))
    return e.select("conv_id", "turn", F.array_join(parts, " ").alias("vector"))


_KNOWN = f"[{', '.join(quoted(w) for w in KNOWN)}]"
KNOWN_WORD_EMBEDDING = r"""
WITH t AS (SELECT conv_id, turn, regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]') AS words FROM conversations),
c AS (SELECT conv_id, turn, list_transform({known}, lambda k: len(list_filter(words, lambda w: w = k))::DOUBLE) AS counts FROM t),
n AS (SELECT *, sqrt(list_sum(list_transform(counts, lambda x: x * x))) AS length FROM c)
SELECT conv_id, turn, array_to_string(list_transform(counts, lambda x: round(CASE WHEN length > 0 THEN x / length ELSE 0.0 END, 4)::VARCHAR), ' ') AS vector
FROM n""".replace("{known}", _KNOWN)


def keyword_density(spark, sf):
    d = load(spark, sf, "documents")
    stuffing = ("", "password " * 6, "buy " * 500)
    text = planted(F.col("text"), stuffing, F.col("doc_id"))
    return d.select("doc_id", F.round(ret.keyword_density(text), 6).alias("keyword_density"))


_STUFFED = f"(SELECT doc_id, {sql_planted('text', ('', 'password ' * 6, 'buy ' * 500), 'doc_id')} AS text FROM documents)"
KEYWORD_DENSITY = f"""
SELECT d.doc_id, round(coalesce(density, 0.0), 6) AS keyword_density FROM documents d LEFT JOIN (
  SELECT doc_id, max(n) / sum(n)::DOUBLE AS density
  FROM (SELECT doc_id, tok, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS tok FROM {_STUFFED}) GROUP BY ALL)
  GROUP BY doc_id) k USING (doc_id)"""


def token_counts(spark, sf):
    counts = ret.token_counts(load(spark, sf, "documents"), "doc_id", "text")
    return counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("distinct_tokens"), F.sum("n").alias("tokens"),
                                        F.max("n").alias("top"))


TOKEN_COUNTS = """
SELECT doc_id, count(*) AS distinct_tokens, sum(n)::BIGINT AS tokens, max(n) AS top
FROM (SELECT doc_id, tok, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS tok FROM documents) GROUP BY ALL)
GROUP BY doc_id"""


def retrieval_counts(spark, sf):
    utc(spark)
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = ret.retrieval_counts(events, "user_id", "ts", 3600)
    return c.select("user_id", F.unix_seconds("window_start").alias("window_start"), "retrieval_count",
                    F.round("retrieval_frequency", 9).alias("retrieval_frequency"))


RETRIEVAL_COUNTS = """
SELECT user_id, (epoch_us(ts) // 3600000000) * 3600 AS window_start, count(*) AS retrieval_count,
       round(count(*) / 3600.0::DOUBLE, 9) AS retrieval_frequency FROM events GROUP BY 1, 2"""


def retrieval_sliding(spark, sf):
    utc(spark)
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = ret.retrieval_counts(events, "user_id", "ts", 86400, 21600)
    return c.select("user_id", F.unix_seconds("window_start").alias("window_start"), "retrieval_count")


RETRIEVAL_SLIDING = """
SELECT user_id, w AS window_start, count(*) AS retrieval_count
FROM (SELECT user_id, (epoch_us(ts) // 21600000000) * 21600 - unnest([0, 21600, 43200, 64800]) AS w FROM events)
GROUP BY 1, 2"""


def retrieval_analysis(spark, sf):
    """Events as retrievals: the text from the log, counts per user and hour."""
    utc(spark)
    e = load(spark, sf, "events")
    words = F.when(F.col("event_id") % 5 == 0, F.repeat(F.lit("password "), 6)).otherwise(
        F.concat_ws(" ", "event_type", "props"))
    log = e.select(
        "event_id", words.alias("query"), (F.col("event_id") % 40 * 1000).alias("retrieval_count"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3 * 1800).alias("time_window"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 2 == 0).alias("is_verified"),
        (F.col("value") / 500.0).alias("relevance_score"),
        F.when(F.col("event_id") % 3 != 0, F.lit(0.9)).alias("user_trust_score"))
    r = F.col("retrieval_analysis")
    return ret.retrieval_analysis(log).select(
        "event_id", F.round(r["keyword_density"], 6).alias("keyword_density"),
        F.round(r["retrieval_frequency"], 6).alias("retrieval_frequency"),
        F.round(r["priority_score"], 6).alias("priority_score"), r["is_safe"].alias("is_safe"))


RETRIEVAL_ANALYSIS = """
WITH q AS (SELECT event_id, value, CASE WHEN event_id % 5 = 0 THEN repeat('password ', 6)
                  ELSE event_type || ' ' || props END AS query FROM events),
k AS (SELECT event_id, max(n) / sum(n)::DOUBLE AS density
      FROM (SELECT event_id, tok, count(*) AS n
            FROM (SELECT event_id, unnest(regexp_extract_all(lower(query), '[\\pL\\pN_]+')) AS tok FROM q) GROUP BY ALL)
      GROUP BY event_id),
s AS (SELECT event_id, value, density, (event_id % 40) * 1000 AS n,
             CASE WHEN event_id % 7 <> 0 THEN event_id % 3 * 1800 ELSE 3600 END AS seconds FROM q JOIN k USING (event_id)),
f AS (SELECT *, CASE WHEN seconds > 0 THEN n / seconds::DOUBLE ELSE 0.0 END AS freq FROM s)
SELECT event_id, round(density, 6) AS keyword_density, round(freq, 6) AS retrieval_frequency,
       round(((CASE WHEN event_id % 4 <> 0 AND event_id % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE + value / 500.0::DOUBLE
              + (CASE WHEN event_id % 3 <> 0 THEN 0.9 ELSE 0.5 END)::DOUBLE) / 3.0::DOUBLE, 6) AS priority_score,
       NOT (density > 0.8 OR freq > 10) AS is_safe
FROM f"""

QUERIES = {
    "pii_spans": (pii_spans, PII_SPANS),
    "pii_redact": (pii_redact, PII_REDACT),
    "pii_redact_spans": (pii_redact_spans, PII_REDACT_SPANS),
    "policy_check": (policy_check, POLICY_CHECK),
    "output_filter": (output_filter, OUTPUT_FILTER),
    "missing_disclaimers": (missing_disclaimers, MISSING_DISCLAIMERS),
    "entity_spans": (entity_spans, ENTITY_SPANS),
    "dictionary_entities": (dictionary_entities_query, DICTIONARY_ENTITIES),
    "dictionary_keywords": (dictionary_keywords_query, DICTIONARY_KEYWORDS),
    "toxicity_score": (toxicity, TOXICITY),
    "toxicity_model": (toxicity_model, None),
    "text_embedding": (text_embedding_query, TEXT_EMBEDDING),
    "known_word_embedding": (known_word_embedding, KNOWN_WORD_EMBEDDING),
    "keyword_density": (keyword_density, KEYWORD_DENSITY),
    "token_counts": (token_counts, TOKEN_COUNTS),
    "retrieval_counts": (retrieval_counts, RETRIEVAL_COUNTS),
    "retrieval_sliding": (retrieval_sliding, RETRIEVAL_SLIDING),
    "retrieval_analysis": (retrieval_analysis, RETRIEVAL_ANALYSIS),
}
