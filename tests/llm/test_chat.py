"""Round trips of formatted conversations."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textguard.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
CONTROL = ["### ", "</turn>", " </turn>\n", "\\", "\n", ": ", "### Assistant: ", "x", "", " ", "é", "\\</turn>", "###", "🙂"]
texts = st.lists(st.sampled_from(CONTROL), max_size=6).map("".join)


def formatted(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "", "\\", "### x"]), texts), min_size=30, max_size=60))
def test_any_text_comes_back(spark, turns):
    rows = [(k // 3, k % 3, role, text) for k, (role, text) in enumerate(turns)]
    for r in formatted(spark, rows).collect():
        own = [(role, text) for conv, _, role, text in rows if conv == r.conv]
        assert [(t.role, t.text) for t in r.turns] == own and r.round_trip
        assert r.loss_text == "".join(text for role, text in own if role == "assistant")
        bodies = [r.formatted[s.start: s.end] for s in r.loss_spans]
        assert len(bodies) == sum(role == "assistant" for role, _ in own)


def test_template_and_digest(spark):
    rows = [(1, 1, "assistant", "ok"), (1, 0, "user", "hi"), (2, 0, "user", "say </turn> and \\"), (2, 1, "assistant", None), (None, None, None, "x")]
    got = {r.conv: r for r in formatted(spark, rows).collect()}
    assert got[1].formatted == "### user: hi </turn>\n### assistant: ok </turn>\n"
    assert got[2].formatted == "### user: say \\</turn> and \\\\ </turn>\n### assistant:  </turn>\n"
    assert [(t.role, t.text) for t in got[None].turns] == [("", "x")]
    r = chat.digest(formatted(spark, rows)).where("conv_id = 1").first()
    assert r.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nok\n").hexdigest()
    assert (r.n_turns, r.loss_chars, r.formatted_chars) == (2, 2, len(got[1].formatted))
    assert r.loss_sha256 == hashlib.sha256(b"ok").hexdigest()


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")]
    assert [t.text for t in formatted(spark, rows).first().turns] == ["first", "a", "a", "b"]
    assert formatted(spark, rows).where("false").collect() == []
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation(spark):
    many = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                                    F.repeat(F.lit("word "), 50).alias("text"))
    r = chat.digest(chat.format_chats(many)).first()
    assert r.round_trip and r.n_turns == 3000 and r.loss_chars == 3000 * 250
