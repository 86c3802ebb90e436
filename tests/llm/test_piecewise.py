"""SentencePiece ids against the library, and the round trip."""

import random

import public_tokenizers
import pytest
import sentencepiece

from textguard.llm import piecewise

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", " a", "a ", "a  b   c", "\n", "a\nb\n\n c", "\t x", "aaaaaaaaaaaaaaaa", "日本語 テスト", "🙂 x 🙂🙂", "été ß Ω",
       "▁x ▁▁y", "<s> </s> <unk> <0x41>", "http://www.example.com/a?b=c&d=e", "1234567890 3.14", "x" * 3000, "ab" * 2000,
       "The quick brown fox, jumps over the lazy dog's tail; isn't it?", "\x00 ​ ﻿", "é é"]


@pytest.fixture(scope="module")
def model():
    return piecewise.Model(PATH)


def test_ids_equal_the_library(model, small):
    rng = random.Random(2)
    letters = "abcdeehilnorstuyéà ,.'▁ABT\n0139"
    texts = [r.text for r in small("documents").collect()] + ODD
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoder = piecewise.Encoder(model, at_once=20_000)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert got.tolist() == library.encode(text), text
    encoder.limit = 1  # forgets, and finds the same
    assert [g.tolist() for g in encoder.encode(texts[:50])] == [library.encode(t) for t in texts[:50]]


def test_decoding(model, small):
    encoder = piecewise.Encoder(model)
    texts = [t for t in [r.text for r in small("documents").collect()] + ODD if "▁" not in t]
    assert [model.decode(i) for i in encoder.encode(texts)] == texts


def test_unigram_is_the_best_sum(model):
    other = piecewise.Model.__new__(piecewise.Model)
    other.__dict__ = {**model.__dict__, "kind": "unigram"}
    for text in ("theretheone", "ananas", "elle", "tions"):
        unit = "▁" + text
        best = {0: (0.0, [])}
        for end in range(1, len(unit) + 1):
            best[end] = max(((best[s][0] + model.score[k], best[s][1] + [k]) for k, p in model.text.items()
                             for s in [end - len(p)] if s >= 0 and s in best and unit[s:end] == p), key=lambda c: c[0])
        ids, _ = other.segment([unit])
        assert abs(sum(model.score[ids]) - best[len(unit)][0]) < 1e-6


def test_frames(spark, model):
    rows = [(1, "a b", "z"), (2, None, "z"), (3, "", "z"), (None, "a b", "z"), (1, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = piecewise.encode(df, PATH, check=True)
    found = sorted(((r.doc_id or 0, r.ids, r.round_trip) for r in got.collect()), key=str)
    ids = sentencepiece.SentencePieceProcessor(model_file=PATH).encode("a b")
    assert found == sorted([(1, ids, True), (2, None, None), (3, [], True), (0, ids, True), (1, ids, True)], key=str)
    assert [r.text for r in piecewise.decode(got.where("doc_id = 1"), PATH).collect()] == ["a b", "a b"]
    assert piecewise.encode(df.where("false"), PATH).collect() == []
