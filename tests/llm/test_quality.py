"""Quality measures against plain loops, and the cascade's order and verdicts."""

import re
from collections import Counter

from pyspark.sql import functions as F

from textguard.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n ", "one", "a b c d e f g h i j", "a b c d e " * 4, "x y\nx y\nx y\nx y\nb c\n\n\n", "#*$ %& |<>" * 30, "ABC DEF " * 20,
       "é " * 40, "a\x0bb\x0cc\rd\te", "w " * 20_000, "\n".join(f"line {i % 3} of text" for i in range(40)), " ".join(map(str, range(3000)))]


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    five = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    often = Counter(five)
    covered = {j for i, w in enumerate(five) if often[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, small):
    texts = [r.text for r in small("documents").collect()] + ODD
    df = spark.createDataFrame([(i, t, True, 5) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, n_words int")
    got = quality.measured(df)
    for r in got.collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert {r.doc_id for r in quality.cascade(df).collect()} == kept and 0 < len(kept) < len(texts)
    assert quality.cascade(df).columns == df.columns
    assert quality.measured(df.where("false")).collect() == [] == quality.cascade(df.where("false")).collect()


def test_order_of_rules(spark):
    df = spark.range(500).select(F.col("id"), F.repeat(F.lit("some words "), 50).alias("text"))
    dear = F.length(F.regexp_replace(F.repeat("text", 300), "(s|o)+(m|e)*", "y")) < 0
    todo = [quality.Rule("dear and rare", dear), quality.Rule("cheap and frequent", F.col("id") < 450)]
    ordered = quality.order_rules(df, todo)
    assert [r.name for r in ordered] == ["cheap and frequent", "dear and rare"]
    names = {r.id: r.name for r in df.select("id", quality.broken(ordered).alias("name")).collect()}
    assert names[0] == "cheap and frequent" and names[499] is None


def test_labelled_documents(spark):
    """Documents labelled good stay, apart from those the base rules name; those labelled bad go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.measured(docs).join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if(F.col("kept")).alias("kept"), F.count_if(F.expr("kept or base_failed")).alias("clean")).collect()
    by = {r.quality: r for r in rows}
    assert by[0].kept <= 0.01 * by[0].n and by[1].clean == by[1].n


def test_dear_measures_wait(spark):
    """What only a rule needs is computed above the measures that every row has, inside the rules' branches."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = quality.measured(docs)._jdf.queryExecution().optimizedPlan().toString()
    projects = plan.split("Project [")[1:]  # from the top; literals hold line feeds
    assert "CASE WHEN" in projects[0] and quality.CAPITALS in projects[0]
    assert len(projects) > 1 and all(quality.CAPITALS not in below for below in projects[1:])


def test_costs_are_no_noise(spark):
    """Five measurements of dear rules lie within a factor of two, on a small table as well; and the
    order puts a rule that costs as much but rejects far more first each time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    sample = quality.sample_of(docs, 10_000)
    todo = [rule for rule in quality.text_rules() if rule.name in ("few_words", "repeats", "symbols")]
    found = [quality.costs(sample, todo) for _ in range(5)]
    for rule in todo:
        times = [f[rule.name] for f in found]
        assert max(times) < 2 * min(times) + 0.02, (rule.name, times)
    twins = [quality.Rule("rare", F.regexp_count("text", F.lit("[aeiou]")) < -1), quality.Rule("frequent", F.regexp_count("text", F.lit("[aeiou]")) >= 0)]
    assert [[r.name for r in quality.ranked(sample, twins)] for _ in range(3)] == [["frequent", "rare"]] * 3
