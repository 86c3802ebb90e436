"""Line classes by slices at every place: whole lines, long words, short lines, recall by length."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import test_lines
from test_lines import brute, similar

from textguard.llm import lines


def left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.dedup_lines(df).select("row.doc_id", "text").collect()}


def test_every_place(spark):
    rows = test_lines.corpus()
    rng = random.Random(8)
    for doc, text in rows[:20]:  # one letter of a line is another one
        at = rng.randrange(len(text) + 1)
        rows.append((100 + doc, text[:at] + "q" + text[at + 1:]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).select("row.doc_id", "text").collect()}
    assert got == brute(rows)


def test_typo(spark):
    line = "several people walked along river banks before sunset while others stayed inside watching television"
    assert left(spark, [line, line.replace("sunset", "sumset")]) == {0: line, 1: ""}


def test_tails_of_long_words(spark):
    """Lines that differ only behind the twelfth character of their words."""
    head = "see the mirrors listed here for downloads of the release: "
    texts = [head + " ".join(f"https://www.{host}.org/{k}" for k in "ab") for host in ("alpha", "gamma-mirror", "some.other.site")]
    texts += [" ".join(f"000000000000{n * k:06d}" for k in range(1, 11)) for n in (7, 9173)]
    texts += [" ".join(f"internationalisation{end}" for end in ends) for ends in (
        ("table", "handler", "service", "office", "bureau", "layer", "planner", "guideline"),
        ("xml", "json", "yaml", "toml", "csv", "parquet", "avro", "orc"))]
    assert not similar(texts[0], texts[1]) and not similar(texts[3], texts[4])
    assert left(spark, texts) == brute(list(enumerate(texts)))
    assert left(spark, texts)[1] == texts[1] and left(spark, texts)[4] == texts[4]


def test_short_lines(spark):
    texts = ["all rights reserved by owner", "- all rights reserved by owner", "this text is licensed under terms below",
             "1. this text is licensed under terms below", "0123456789a", "0123456789ab", "yes", "yes.", "no comments", "no comment"]
    rng = random.Random(3)
    for _ in range(150):
        line = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(4, 44))).strip() + "."
        texts += [line, rng.choice("-*1") + line, line + rng.choice("!?0")]
    got = left(spark, texts)
    assert got == brute(list(enumerate(texts)))
    assert [got[k] for k in (1, 3, 5)] == ["", "", ""] and got[7] == "yes."


@pytest.mark.parametrize("common, least", [(4, 1), (8, 1), (12, 1), (24, 1), (28, 1), (40, 0.99), (80, 0.99), (400, 0.99)])
def test_recall_at_the_limit(spark, common, least):
    """Pairs with a similarity of 0.8 or little more: `common` slices in both, the others at their ends."""
    rng = random.Random(common)
    own, pairs = common // 4, []
    for k in range(1000):
        inner = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(common + 7))
        before = "".join(rng.choice("0123456789") for _ in range(own // 2))
        after = "".join(rng.choice("0123456789") for _ in range(own - own // 2))
        assert similar(before + inner, inner + after)
        pairs += [(k, before + inner), (k, inner + after)]
    df = spark.createDataFrame(pairs, "pair long, line string").withColumn("id", F.xxhash64("line"))
    keys = lines.buckets_of(df).join(df.select("id", "pair"), "id")
    found = keys.groupBy("pair", "key").agg(F.count_distinct("id").alias("both")).where("both = 2").select("pair").distinct().count()
    assert found >= 1000 * least
