import unicodedata

import pytest
from pyspark.sql import functions as F

from textguard.functions import text as tx
from textguard.functions import threats


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in rows.select("i", column(F.col("t"))).orderBy("i").collect()]


def test_clean(spark):
    cases = {"a​b": "ab", "a   b": "a b", "a\nb": "ab", " x ": "x", "a\tb": "ab", "x⁦y": "xy",
             "a b": "a b", "a　 b": "a b", None: None, "": "", "pаypal.com": "pаypal.com", "é  ü": "é ü"}
    assert values(spark, list(cases), tx.clean) == list(cases.values())


def test_fold_homoglyphs(spark):
    assert values(spark, ["pаypal.com"], lambda c: tx.clean(c, fold_homoglyphs=True)) == ["paypal.com"]


def test_nfkc(spark):
    texts = ["ﬁne", "ｉｇｎｏｒｅ", "plain", "é", "é", None, "①②", "Größe 𝐀"]
    assert values(spark, texts, tx.nfkc) == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_strip_like_python(spark):
    texts = [" a ", "\x1fa\x1c", " a ", "a b", "", "\n\t"]
    assert values(spark, texts, tx.strip) == [t.strip() for t in texts]


def test_words_like_python(spark):
    texts = ["A b  C", "", "  ", "x y", "É\tß\x1fz"]
    assert values(spark, texts, tx.words) == [t.lower().split() for t in texts]


def test_trivial(spark):
    texts = ["ok", "", "   ", "hello you", "a1", "hello you all", "Größe", "no!", "a\tb"]
    prompt = [len(t.strip()) <= 10 and all(c.isalpha() or c.isspace() for c in t.strip()) for t in texts]
    turn = [len(t.strip()) <= 10 and t.strip().replace(" ", "").isalpha() for t in texts]
    assert values(spark, texts, tx.is_trivial_prompt) == prompt
    assert values(spark, texts, tx.is_trivial_turn) == turn
    assert prompt[1] and not turn[1]


def test_chunks(spark):
    texts = ["", "abc", "abcd", "abcdefghi"]
    assert values(spark, texts, lambda c: tx.chunks(c, 4)) == [[""], ["abc"], ["abcd"], ["abcd", "efgh", "i"]]
    rows = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<int>")
    assert [r[0] for r in rows.select(tx.array_chunks(F.col("a"), 2)).collect()] == [[[1, 2], [3, 4], [5]], []]


def test_exit_probability_cannot_trigger(spark):
    top = spark.range(1).select(tx.exit_probability(F.lit(50.0), F.lit(1.0))).first()[0]
    assert 0.989 < top < 0.99


@pytest.mark.parametrize("text, name", [
    ("SELECT * FROM users;", "sql_injection"), ("../../../etc/passwd", "path_traversal"),
    ("<script>alert(1)</script>", "script_tag"), ("${system('rm -rf /')}", "command_injection"),
    ("eval(base64_decode('...'))", "code_injection")])
def test_malicious(spark, text, name):
    assert name in values(spark, [text], threats.malicious_patterns)[0]


def test_malicious_leaves_prose_alone(spark):
    assert values(spark, ["Select a book from the shelf and evaluate it"], threats.malicious_patterns) != [None]
    assert values(spark, ["Tell me about machine learning"], threats.malicious_patterns) == [[]]


def test_characters(spark):
    texts = ["Hello\x00World", "Hello‮World", "Hello\\u0000World", "Hello​World", "Hello"]
    assert values(spark, texts, threats.character_threats) == [
        ["null_byte"], ["rtl_override"], ["escaped_null"], ["zero_width"], []]


def test_repetition(spark):
    texts = ["test " * 50, "a" * 100, "." * 50, "a normal sentence with several words in it", "a" * 49, "", None]
    assert values(spark, texts, lambda c: F.coalesce(threats.repetition(c), F.lit(False))) == [
        True, True, True, False, False, False, False]


def test_homographs(spark):
    texts = ["Visit pаypal.com", "googlе.com", "аpple.com", "только русский", "only latin"]
    found = values(spark, texts, threats.mixed_script_words)
    assert [len(f) for f in found] == [1, 1, 1, 0, 0]


def test_length(spark):
    assert values(spark, ["x" * 10, "x" * 11], lambda c: threats.length_exceeded(c, 10)) == [False, True]


def test_context_warnings(spark):
    rows = spark.createDataFrame([(None, None), ("u", "invalid"), ("u", "1693276800"), ("u", "2024-01-01")], "u string, t string")
    got = [r[0] for r in rows.select(threats.context_warnings(F.col("u"), F.col("t"))).collect()]
    assert got == [["missing_user", "missing_timestamp"], ["invalid_timestamp"], [], []]


def test_texts_of_a_batch_in_pieces():
    """What is worked on at once is bounded by bytes; nulls, empty and long texts and slices come out in place."""
    import pyarrow as pa

    from textguard.functions import injection, text

    sizes = []

    def upper(texts):
        sizes.append(sum(len(t or "") for t in texts.to_pylist()))
        return pa.array([t and t.upper() for t in texts.to_pylist()], pa.string())

    values = [None, "", "a" * 5000, *["b" * (k % 90) for k in range(500)], None]
    texts = pa.array(["skipped", *values], pa.string()).slice(1)
    assert text.in_pieces(upper, 1000)(texts).to_pylist() == [t and t.upper() for t in values]
    assert max(sizes) < 5000 + 1000 and sorted(sizes)[-2] <= 1000 + 90 and len(sizes) > 20
    assert text.in_pieces(upper)(pa.array([], pa.string())).to_pylist() == []
    long = pa.array(["x" * 300_000, "jailbreak", None, "\ufb01n " * 100_000] * 3, pa.string())
    for function in (text._normalizer(), injection._matcher()):
        assert function(long).to_pylist() == [function(long.slice(k, 1))[0].as_py() for k in range(12)]
