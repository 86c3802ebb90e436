"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import alignment, bytepair, chat, covertree, language, lines, packing, piecewise, quality, repair, scoring, simhash, warc
from textguard.llm.words import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.digest(chat.format_chats(turns.unionByName(planted)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN contains(text, '### ') OR contains(text, '</turn>') OR regexp_matches(text, '(?s)\\.')
  THEN replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') ELSE text END AS body,
  replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars, TRUE AS round_trip
FROM e GROUP BY conv_id
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tests compare with the sentencepiece library."""
    found = piecewise.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL for the model; tests hold the base score against plain counts."""
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: byte-pair ids are no SQL function; tests compare with the tokenizers library."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, i, words[i:i+4] AS five FROM
  (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM p),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
  (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS wc,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-ZÀ-ÏÑ-ÖØ-Ý]', '', 'g')) AS n_capitals,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
v AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_capitals > word_chars OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM v
"""

def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: MinHash buckets; tests hold the classes against all pairs."""
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("row.doc_id", "text", "n_lines", "n_removed")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: iterative; tests hold counts against a loop and predictions against held-out labels."""
    return language.languages(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: XXH64 is no SQL function; tests compare with brute force."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is captured twice: a response at the time its number gives, and a not-modified
    answer to a later request (for every seventh page, an earlier one) by the validators of
    the first. Pages with one canonical URL see each other's captures."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("md5"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    number = F.col("page_id").cast("string")
    tag = F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.concat(
        F.when(F.col("page_id") % 3 == 1, F.lit("W/\"")).otherwise(F.lit("\"")), F.substring("md5", 1, 8), F.lit("\"")))
    date = F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("day "), F.substring("md5", 9, 2)))

    def headers(**fields) -> Column:
        pairs = F.array(*[F.struct(F.lit(name.replace("_", "-")).alias("key"), value.alias("value")) for name, value in fields.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (10 * F.col("page_id")).alias("ts"), F.lit("response").alias("type"),
        headers(ETag=tag, Last_Modified=date, Date=number, Content_Length=F.col("n").cast("string"),
                Content_Type=F.lit("text/html")).alias("headers"))
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url",
        F.when(F.col("page_id") % 7 == 0, 10 * F.col("page_id") - 5).otherwise(10 * F.col("page_id") + 20_005).alias("ts"),
        F.lit("revisit").alias("type"),
        headers(etag=F.regexp_replace(tag, "^W/", ""), last_modified=date, date=F.concat(F.lit("again "), number),
                content_length=F.lit("0"), cache_control=F.lit("max-age=60")).alias("headers"))
    found = warc.resolve_revisits(first.unionByName(again))
    return found.withColumn("headers", warc.header_text(F.col("headers")))


OP9_SQL = r"""
WITH p AS (SELECT page_id, md5(coalesce(html, '')) AS m, length(coalesce(html, '')) AS n,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://', '') AS bare FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), '^www[0-9]*\.|:(80|443)$', '', 'g') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM p),
c AS (SELECT page_id, m, n, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url,
  CASE WHEN page_id % 3 <> 0 THEN '"' || m[1:8] || '"' END AS tag, CASE WHEN page_id % 5 <> 0 THEN 'day ' || m[9:10] END AS day,
  CASE WHEN page_id % 3 = 1 THEN 'W/' ELSE '' END AS weak FROM h),
v AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 10 * page_id - 5 ELSE 10 * page_id + 20005 END AS ts FROM c),
j AS (SELECT v.page_id, v.url, v.tag, v.day, s.page_id AS sid, s.tag AS stag, s.day AS sday, s.n AS sn, s.weak AS sweak FROM v
  ASOF LEFT JOIN (SELECT *, 10 * page_id AS at FROM c) s ON v.url = s.url AND v.ts > s.at),
o AS (SELECT *, CASE WHEN sid IS NULL THEN 'no_response' WHEN tag = stag THEN 'resolved' WHEN tag <> stag THEN 'changed'
  WHEN day = sday THEN 'resolved' WHEN day <> sday THEN 'changed' ELSE 'unverified' END AS outcome FROM j)
SELECT 2 * page_id + 1 AS record_id, url AS canonical_url, outcome, 2 * sid AS refers_to, CASE WHEN outcome = 'resolved' THEN
  'cache-control: max-age=60' || chr(10) || 'content-length: ' || sn || chr(10) || 'content-type: text/html' || chr(10)
  || 'date: again ' || page_id || coalesce(chr(10) || 'etag: ' || coalesce(tag, sweak || stag), '')
  || coalesce(chr(10) || 'last-modified: ' || coalesce(day, sday), '') END AS headers
FROM o
"""


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: ids are no SQL function; tests compare with a loop over the two libraries."""
    found = alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        keep=lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256)))
    return found.withColumnRenamed("groups", "groups_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults; rows that are dropped stay with `dropped` set, so that
    conversations that lose all of their rows can be returned."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: least edits need a search; tests compare with brute force."""
    turns, dropped = damaged(table(spark, sf_dir, "conversations")), F.col("dropped")
    found = repair.repaired(turns, repair.assess(turns, absent=dropped), absent=dropped)
    return repair.digest(found).withColumnRenamed("conv", "conv_id")


def op13_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: byte-pair ids are no SQL function; tests compare with the library on whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bytepair.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    found = bytepair.decode(ids, path, public_tokenizers.PATTERN)
    none = F.lit("").cast("binary")
    return found.select(
        "doc_id", "n_tokens", F.sha2(F.coalesce("packed", none), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("raw", none), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_chat": (op1_chat, OP1_SQL),
    "op2_sentencepiece": (op2_sentencepiece, None),
    "op3_scoring": (op3_scoring, None),
    "op4_packing": (op4_packing, None),
    "op5_quality": (op5_quality, OP5_SQL),
    "op6_lines": (op6_lines, None),
    "op7_language": (op7_language, None),
    "op8_simhash": (op8_simhash, None),
    "op9_revisits": (op9_revisits, OP9_SQL),
    "op10_vectors": (op10_vectors, OP10_SQL),
    "op11_alignment": (op11_alignment, None),
    "op12_repair": (op12_repair, None),
    "op13_bytepair": (op13_bytepair, None),
}
