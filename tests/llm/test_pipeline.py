"""The pipeline's stages against plain versions of their rules, one after the other."""

import re
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import test_lines
from test_packing import check as check_packed
import test_simhash

import corpus_pipeline
from textguard.llm import language

WORDS = re.compile("[^\x20\x09-\x0d]+")


def keeps(text):
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    five = [tuple(words[i: i + 5]) for i in range(n - 4)]
    often = Counter(five)
    covered = {j for i, w in enumerate(five) if often[w] > 1 for j in range(i, i + 5)}
    chars = sum(map(len, words))
    dup = len(lines) - len(set(lines))
    capitals = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ" for c in text)
    return not (n < 10 or 100 * len(covered) > 20 * n or chars < 2 * n or chars > 15 * n or 2 * capitals > chars
                or 10 * sum(text.count(c) for c in "#*$%&|<>") > n or (dup >= 3 and 10 * dup > 3 * len(lines)))


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    last = docs.orderBy(F.desc("doc_id")).limit(5)
    docs = docs.unionByName(last).unionByName(last.select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert found.dtypes == docs.dtypes
        rows = found.collect()
        docs = spark.createDataFrame(rows, found.schema)
        out.append(rows)
    return out


def key(rows):
    return sorted(map(str, rows))


def test_language(spark, stages):
    docs = spark.createDataFrame(stages[0])
    names, model = language.learn(docs, ~language.held_out() & F.col("doc_id").isNotNull())
    want = []
    for row in stages[0]:
        share = language.mixtures(language.trigrams([row.text or ""]), model)[0]
        if share.max() >= 0.5 and any(c.isalpha() for c in row.text or ""):
            want.append(row)
    assert key(stages[1]) == key(want) and len(want) > 200


def test_quality(stages):
    assert key(stages[2]) == key([r for r in stages[1] if keeps(r.text)]) and len(stages[2]) < len(stages[1])


def test_line_dedup(stages):
    want = test_lines.brute(sorted({(r.doc_id, r.text) for r in stages[2]}))
    assert {(r.doc_id, r.text) for r in stages[3]} == set(want.items()) and len(stages[3]) == len(stages[2])
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_near_copies(stages):
    rows = sorted({(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in stages[3]})
    tops = test_simhash.classes([test_simhash.slow_fingerprint(r[1]) for r in rows])
    first = {}
    for row, top in zip(rows, tops, strict=True):
        first[top] = min(first.get(top, row), row)
    assert key(map(tuple, stages[4])) == key(first.values())


def test_packing(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in stages[4]}
    assert sum(r.length for r in stages[5]) == sum(map(len, want.values()))
    check_packed(stages[5], want, 2048)


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false").withColumn("row", F.lit(1)).withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "/root/testdata/sf0.001")
        assert found.collect() == [] and (name == "packing" or found.columns == docs.columns)
