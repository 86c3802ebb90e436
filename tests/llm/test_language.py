"""Language shares: counts against a plain loop, held-out accuracy, mixtures."""

import numpy as np
from pyspark.sql import functions as F

from textguard.llm import language


def test_counts(monkeypatch):
    texts = ["", "a", "Ab c1d", "été ß", "x" * 40, "日本 ab\ncd"]
    whole = language.trigrams(texts)
    for text, got in zip(texts, whole, strict=True):
        low = f"\n{text.lower()}\n"
        assert got.sum() == sum(c.isalpha() for c in low)
    monkeypatch.setattr(language, "SLICE", 7)  # slices give the same counts
    assert np.array_equal(language.trigrams(texts), whole)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs)
    rows = {r.doc_id: r for r in got.collect()}
    truth = {r.doc_id: r for r in docs.select("doc_id", "lang", "text", "n_chars").collect()}
    assert rows.keys() == truth.keys()
    held = [r for r in rows.values() if r.held_out]
    good = [r.lang_pred == truth[r.doc_id].lang for r in held]
    assert 0.2 < len(held) / len(rows) < 0.3 and np.mean(good) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    # the answer does not depend on the other columns
    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(1))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(other).collect()}
    assert all(abs(again[d][1] - r.score) < 1e-6 and again[d][0] == r.lang_pred for d, r in rows.items())


def test_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500")
    names, model = language.learn(docs, F.lit(True))
    by_lang = {r.lang: r.text for r in docs.where("n_chars < 6000").collect()}
    counts = language.trigrams([by_lang["en"][:1500], by_lang["en"][:1500] + " " + by_lang["de"][:1500], "12 34", ""])
    share = language.mixtures(counts, model)
    en, de = names.index("en"), names.index("de")
    assert share[0, en] > 0.99 and (share[0] > 0).sum() == 1
    assert 0.35 < share[1, en] < 0.65 and 0.35 < share[1, de] < 0.65 and (share[1] > 0).sum() == 2


def test_odd_rows(spark):
    rows = [(None, "the cat", "en", 1), (1, None, "en", 1), (2, "12 !", "en", 1), (3, "the cat sat", "en", 1),
            (4, "der hund", None, 1), (5, "", None, 1), (3, "the cat sat", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = language.languages(df).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (1, 2, 5)} == {"und"}
    assert language.languages(df.where("false")).collect() == []
    assert {r.lang_pred for r in language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
