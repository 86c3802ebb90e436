import math
import re

import pytest
from pyspark.sql import functions as F

from catalog.common import PERSONAL
from textguard import rules
from textguard.functions import pii, policy
from textguard.operators.entities import dictionary_entities, entity_finder
from textguard.operators.output import filter_text
from textguard.operators.toxicity import toxicity_score, train_toxicity, word_odds_score, word_weights


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("kind, value", [
    ("email", "user@example.com"), ("phone", "123-456-7890"), ("ssn", "123-45-6789"),
    ("credit_card", "4111-1111-1111-1111"), ("ip_address", "192.168.1.1"), ("date_of_birth", "01/01/1990")])
def test_each_type(spark, kind, value):
    text = f"User info: {value}"
    spans = one(spark, text, pii.pii_spans)
    assert [(s.type, s.text, s.start, s.end, s.confidence) for s in spans] == [(kind, value, 11, 11 + len(value), 1.0)]
    assert one(spark, text, pii.redact_pii) == f"User info: [REDACTED-{kind}]"


def test_spans_like_finditer(spark, small):
    """Whole documents, letters and digits beyond ASCII included."""
    tails = [*PERSONAL, "é123-45-6789", "١٢٣-٤٥-٦٧٨٩", "𝟏 a@b.co 𝟐", "1.2.3.4.5.6", "a@b.co,c@d.org 10.0.0.1"]
    rows = [(r.doc_id, f"{r.text} {tails[r.doc_id % len(tails)]}") for r in small("documents").collect()]
    got = {r[0]: [tuple(s) for s in r[1]] for r in spark.createDataFrame(rows, "i long, t string").select(
        "i", pii.pii_spans(F.col("t"))).collect()}
    for i, text in rows:
        expected = [(k, m.group(), m.start(), m.end(), 1.0) for k, b in rules.PII_PATTERNS.items() for m in re.finditer(b, text)]
        assert got[i] == expected


def test_null_text(spark):
    assert one(spark, None, pii.pii_spans) == []
    assert one(spark, None, pii.redact_pii) is None


def test_redaction_of_several(spark):
    text = "Contact John at john@example.com or 123-456-7890"
    assert one(spark, text, pii.redact_pii) == "Contact John at [REDACTED-email] or [REDACTED-phone]"
    assert one(spark, text, lambda c: pii.redact_spans(c, pii.pii_spans(c))) == one(spark, text, pii.redact_pii)


def test_overlapping_spans_keep_the_text_whole(spark):
    got = one(spark, "x 1.2.3.123-456-7890 y", lambda c: pii.redact_spans(c, pii.pii_spans(c)))
    assert got.startswith("x ") and got.endswith(" y") and "456" not in got


@pytest.mark.parametrize("text, expected", [
    ("This contains confidential information", ["Contains restricted keywords: confidential"]),
    ("SECRET private", ["Contains restricted keywords: private, secret"]),
    ("confidential: nothing", []), ("hate_speech here", ["Contains blacklisted content: hate_speech"]),
    ("a" * 2000, []), ("a" * 2001, ["Exceeds maximum length"])])
def test_policy(spark, text, expected):
    assert one(spark, text, policy.violations) == expected


def test_disclaimers(spark):
    full = "text\n" + "\n".join(rules.REQUIRED_DISCLAIMERS)
    assert one(spark, full, policy.missing_disclaimers) == []
    assert one(spark, "text", policy.missing_disclaimers) == list(rules.REQUIRED_DISCLAIMERS)


def test_filter(spark):
    rows = [("fine answer", 0.1), ("mail a@b.co", 0.1), ("a secret plan", 0.1), ("rude", 0.7), ("hm", 0.6), ("a secret a@b.co", 0.9)]
    out = filter_text(spark.createDataFrame(rows, "text string, tox double"), "text", F.col("tox")).collect()
    results = [r.filter_result for r in out]
    assert [r.is_safe for r in results] == [True, True, False, False, True, False]
    assert [round(r.confidence, 6) for r in results] == [1.0, 0.7, 0.7, 0.6, 0.6, 0.0]
    assert out[1].text == "mail a@b.co" and results[1].filtered_text == "mail [REDACTED-email]"
    assert out[2].text == results[2].filtered_text == rules.HARM_REFUSAL


def test_entities(spark):
    names = spark.createDataFrame(
        [("John Smith", "PERSON"), ("Microsoft", "ORG"), ("New York", "GPE"), ("York", "GPE"), ("Customer#001", "PERSON")],
        "name string, type string")
    text = "John Smith works at Microsoft, in New York. Customer#001! (Yorkshire)"
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "i int, t string")
    expected = {("PERSON", "John Smith", 0), ("ORG", "Microsoft", 20), ("GPE", "New York", 34),
                ("GPE", "York", 38), ("PERSON", "Customer#001", 44)}
    spans = df.select(entity_finder(names)("t").alias("s")).collect()
    assert {(s.type, s.text, s.start) for s in spans[0].s} == expected
    assert spans[1].s == [] and spans[2].s == []
    rows = dictionary_entities(df, "i", "t", names).collect()
    assert {(r.type, r.text, r.start) for r in rows} == expected
    redacted = filter_text(df.where("i = 1"), "t", entities=entity_finder(names)("t")).first().filter_result.filtered_text
    assert redacted.startswith("[REDACTED-PERSON] works at [REDACTED-ORG], in ")
    with pytest.raises(ValueError):
        entity_finder(names, max_names=3)


def test_word_weights(spark):
    rows = [("good day you", 0), ("bad you", 1), ("Bad  bad trash", 1), ("good night", 0), ("good\nyou", 0), (None, 1), ("bad trash", 1)]
    weights = word_weights(spark.createDataFrame(rows, "text string, label int"), min_texts=2)
    got = {r.word: r.weight for r in weights.collect()}
    assert got.keys() == {None, "good", "bad", "you", "trash"}
    assert abs(got["bad"] - (math.log(4 / 5) - math.log(1 / 5))) < 1e-9 and abs(got[None]) < 1e-9
    new = spark.createDataFrame([(1, "such a bad thing"), (2, "good"), (3, None), (4, ""), (4, "")], "i int, text string")
    scores = [(r.i, r.toxicity_score) for r in word_odds_score(new, weights, "i").orderBy("i").collect()]
    assert scores[0][1] > 0.5 > scores[1][1] and scores[2] == (3, 0.0) and scores[3][0] == 4


def test_toxicity_learns(spark):
    rows = [("you are stupid garbage", 1), ("what a lovely day", 0), ("stupid worthless thing", 1), ("thank you kindly", 0)] * 10
    df = spark.createDataFrame(rows, "text string, label int")
    model = train_toxicity(df, features=256)
    scores = toxicity_score(spark.createDataFrame([("stupid garbage",), ("lovely day",), (None,)], "text string"), model).collect()
    assert scores[0].toxicity_score > 0.5 > scores[1].toxicity_score and scores[2].toxicity_score == 0.0
