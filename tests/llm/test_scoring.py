"""Base scores against plain counts; the recurrent model against numeric gradients and its own definition."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import scoring
from textguard.llm.gru import Gru, Trainer, log_likelihoods

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def base(rows):
    counts = Counter()
    for doc, text in rows:
        if not held(doc):
            counts.update(SPLIT.findall(low(text)))
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc, text in rows:
        tokens = [*SPLIT.findall(low(text)), "\n"]
        out[doc] = (held(doc), len(tokens), sum(counts[t] > 0 for t in tokens), n,
                    sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    return out


@pytest.mark.parametrize("frequent", [200_000, 300])
def test_scores(spark, frequent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "ÀÉ The the THE " + "w" * 100), (10**6 + 3, "never\x1cseen before")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, score double, word int").repartition(4, "doc_id")
    got = scoring.score_documents(df, frequent=frequent).collect()
    want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * abs(w[4])
    new = [r for r in got if r.held_out and r.n_tokens > 100]
    tokens = sum(r.n_tokens for r in new)
    assert sum(r.score for r in new) / tokens > sum(r.base_score for r in new) / tokens + 0.05


def test_nothing_to_learn(spark):
    only = next(d for d in range(100) if held(d))
    df = spark.createDataFrame([(only, "a b"), (only, "a b"), (only, None)], "doc_id long, text string")
    got = scoring.score_documents(df).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 3] and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in got)
    assert scoring.score_documents(df.where("false")).collect() == []
    none = scoring.score_documents(df.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(none) == 3 and not any(r.held_out for r in none)


def small():
    model = Gru(np.array([5, 3, 2, 9, 1, 4.0]), 3, 4, end=1, seed=3)
    rng = np.random.default_rng(0)
    for part in ("inputs", "carry", "bias", "to_class", "to_word"):
        old = getattr(model, part)
        setattr(model, part, rng.normal(0, 0.5, old.shape))
    return model


def test_gradients():
    model, rng = small(), np.random.default_rng(1)
    before, targets, state = rng.integers(0, 6, (5, 3)), rng.integers(0, 6, (5, 3)), rng.normal(size=(3, 4))
    _, grads, _ = model.window(before, targets, state)
    for part, grad in grads.items():
        values = getattr(model, part)
        for at in rng.choice(values.size, min(8, values.size), replace=False):
            index = np.unravel_index(at, values.shape)
            keep = values[index]
            losses = []
            for sign in (1, -1):
                values[index] = keep + sign * 1e-2
                losses.append(model.window(before, targets, state)[0])
            values[index] = keep
            assert abs((losses[0] - losses[1]) / 2e-2 - grad[index]) < 2e-2 * max(1, abs(grad[index])), part


def test_probabilities_and_carried_state():
    model = small()
    states = np.random.default_rng(2).normal(size=(4, 4))
    total = sum(np.exp(model.log_odds(states, np.full(4, t))) for t in range(6))
    assert np.allclose(total, 1, atol=1e-5)
    docs = [[0, 3, 3, 2, 1], [1], [5, 4, 1], [0, 0, 0, 2, 2, 4, 3, 1]]
    want = []
    for doc in docs:
        state, sum_ = np.zeros((1, 4)), 0.0
        for before, token in zip([1, *doc[:-1]], doc, strict=True):
            state = model.step(np.array([before]), state)
            sum_ += float(model.log_odds(state, np.array([token]))[0])
        want.append(sum_)
    for at_once in (16_000, 2):
        got = log_likelihoods(model, np.concatenate(docs), np.array([len(d) for d in docs]), at_once)
        assert np.allclose(got, want, atol=1e-4)


def test_training_learns_order():
    rng = np.random.default_rng(5)
    docs = [np.append(np.tile([2, 3, 4], 20)[s: s + 40], 1) for s in rng.integers(0, 3, 400)]
    model = Gru(np.bincount(np.concatenate(docs), minlength=6).astype(float), 3, 8, end=1)
    lengths = np.array([len(d) for d in docs])
    before = log_likelihoods(model, np.concatenate(docs), lengths).mean()
    trainer = Trainer(model, streams=16, steps=10)
    for d in docs:
        trainer.learn(d)
    trainer.learn(np.zeros(0, np.int64), last=True)
    assert trainer.tokens == lengths.sum()
    assert log_likelihoods(model, np.concatenate(docs), lengths).mean() > before * 0.3
