"""Byte-pair ids against the library on whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textguard.llm import bytepair, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = bytepair.read_ranks(file.read())
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "s", "re", "ll", "'", "'", " ", " ", "  ", "\n", "\t", "\r\n", "7", "42", ".", "!?", "é", "ß", "日本", " ", " ", "\x85",
                "\x1c", "\x1f", "½", "٣", "é", "😀", "​", "<|endoftext|>", "_", "-"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(400)]


def test_parts_keep_the_ids(library):
    for text in texts():
        for at_most in (1, 3, 17):
            cut = list(bytepair.parts(text, at_most))
            assert "".join(cut) == text
            assert [i for part in cut for i in library.encode_ordinary(part)] == library.encode_ordinary(text), (text, cut)


def test_table(spark, library):
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (4, " " * 250_000 + "y"), (5, "word 12, it's " * 40_000), (5, "word 12, it's " * 40_000),
            (None, "<|endoftext|> ok"), *[(10 + k, t) for k, t in enumerate(texts())]]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, ids string, raw int")
    ids = bytepair.encode(df, RANKS, PATTERN)
    got = [(r.doc_id, r.ids) for r in ids.collect()]
    want = [(d, None if t is None else library.encode_ordinary(t)) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = bytepair.decode(ids, RANKS, PATTERN).collect()
    assert sorted(str((r.doc_id, r.raw and bytes(r.raw))) for r in back) == sorted(str((d, t if t is None else t.encode())) for d, t in rows)
    assert {r.doc_id: (r.n_tokens, r.packed) for r in back}[1] == (0, None)
    assert bytepair.encode(df.where("false"), RANKS, PATTERN).collect() == []
    assert bytepair.decode(ids.where("false"), RANKS, PATTERN).collect() == []


def test_invalid_utf8(spark):
    some = spark.range(1).select(F.col("id").alias("doc_id"), F.array(F.lit(160), F.lit(220)).alias("ids"))
    row = bytepair.decode(some, RANKS, PATTERN).first()
    with open(RANKS, "rb") as file:
        ranks = {v: k for k, v in bytepair.read_ranks(file.read()).items()}
    assert bytes(row.raw) == ranks[160] + ranks[220] and bytes(row.packed) == np.array([160, 220], "<u4").tobytes()


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_bytepair(spark, folder).collect()}
    want = {}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode_ordinary(row.text or "")
        want[row.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    assert got == want
