"""SimHash against brute force."""

import random

import numpy as np
import xxhash

from textguard.llm import simhash
from textguard.llm.graph import components


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \n\t", "one", "One  TWO", "one two three", "ÀÉ ß x y z", "a " * 50, "a b c d " * 300,
         "The quick brown fox jumps over the lazy dog", "the QUICK brown fox jumps over the lazy dog",
         " ".join(f"w{i}" for i in range(30_000))]


def test_fingerprints_and_classes(spark, small):
    docs = small("documents").collect()
    texts = [d.text for d in docs] + TEXTS + [docs[3].text]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("text", "text")
    fps = [slow_fingerprint(t) for t in texts]
    want = {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, classes(fps), strict=True))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == want


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for seed in fps[:12]:  # chains and clouds of near copies
        x = seed
        for _ in range(25):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))))
            fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in fps]
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = classes(fps)
    groups = {}
    for x, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(x)
    for rows in (50_000, 7):  # the second cuts anchors into parts
        found = components(simhash.linked(points, 3, rows)).collect()
        got = {}
        for r in found:
            got.setdefault(r.root, set()).add(r.id)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_block_lengths():
    for n in range(8, 22):
        lengths = simhash.block_lengths(n)
        assert len(lengths) == n and all(x % 2 for x in lengths) and sum(lengths) in (63, 64)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp long, component_id int")
    assert simhash.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c d", 5), (1, "a b c d", 6), (None, "a b c d", 7), (9, None, 8)],
                                 "doc_id long, text string, fp long")
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.doc_id != 9} == {1}
