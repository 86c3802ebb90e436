"""Ids against the tokenizers library; packing against its rules and a plain best fit."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textguard.llm import packing
from textguard.llm.tokens import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "it's we'll I'M don't", "İstanbul ΣΑΣ ﬁne x y z", "a\tb\r\nc", "é ́x", "42 3.14 x2y",
       "<|endoftext|> and<|startoftext|>", "日本語 テスト 🙂🙂", "ÀÉÎ ß ÿ µ ª", "x" * 500, "!!!" * 40 + " 's's", "\x1c a \x85 b", "a  b   c \n\n d"]


def test_ids(small):
    texts = [r.text for r in small("documents").collect()] + ODD
    own, library = WordBpe(PATH), Tokenizer.from_file(PATH)
    ids, sizes = own.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]
    again, _ = own.encode(texts)
    assert again.tolist() == ids.tolist()


def test_forgets():
    own = WordBpe(PATH, words=3)
    first = own.encode(["one two three four five"])[0].tolist()
    assert own.encode(["five four"])[0].tolist() + own.encode(["one"])[0].tolist() == [first[4], first[3], first[0]]


def test_best_fit():
    rng = np.random.default_rng(1)
    for window in (1, 7, 64, 2048):
        lengths = sorted(rng.integers(1, window + 1, 500).tolist(), reverse=True)
        sequence, offset = packing.best_fit(lengths, window)
        used = []
        for need, s, o in zip(lengths, sequence, offset, strict=True):
            fits = [window - u for u in used if window - u >= need]
            if fits:
                assert used[s] == o and window - used[s] == min(fits)
            else:
                assert s == len(used) and o == 0
                used.append(0)
            used[s] += need


def check(rows, want, window):
    seqs = {}
    docs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and {p for _, _, p in parts} == {at if at & (at - 1) == 0 else window}
    for doc, ids in want.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at: at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packed(spark, small):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()] + [(10**6 + k, t) for k, t in enumerate([*ODD, None])]
    library = Tokenizer.from_file(PATH)
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, `group` int")
    for group_rows in (50_000, 20):
        check(packing.pack(df, PATH, group_rows=group_rows).collect(), want, 2048)
    small_windows = packing.pack(df, PATH, window=64, keep_ids=True)
    got = small_windows.collect()
    check(got, want, 64)
    assert all(want[r.doc_id][r.start: r.start + r.length] == r.ids for r in got)
    whole = packing.sequences(spark.createDataFrame(got, small_windows.schema), 64).collect()
    assert sum(s.used for s in whole) == sum(map(len, want.values()))
    assert all(len(s.ids) == (64 if s.used & (s.used - 1) else s.used) for s in whole)


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string, row string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).collect() == []
    got = packing.pack(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")], schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3)]
