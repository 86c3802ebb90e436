"""Line classes against all pairs, and what stays of texts."""

import random

from pyspark.sql import functions as F

from textguard.llm import lines

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa", "lambda", "sigma", "omega", "été", "straße"]


def norm(line):
    return line.strip(" \t\n\x0b\x0c\r").lower()


def slices(line):
    """Shingles: the slices of eight UTF-8 bytes at every place; a shorter line is one."""
    data = line.encode()
    return {data[i: i + 8] for i in range(max(1, len(data) - 7))}


def similar(a, b):
    x, y = slices(a), slices(b)
    return len(x & y) / len(x | y) >= 0.8


def brute(rows):
    """Text per (id, text): one line per component of similar lines, the first by id, text hash aside, and place."""
    texts = sorted({norm(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similar(a, b):
                root[find(a)] = find(b)
    seen, out = set(), {}
    for doc, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            key = norm(line)
            if key and find(key) in seen:
                continue
            if key:
                seen.add(find(key))
            left.append(line)
        out[doc] = "\n".join(left)
    return out


def corpus():
    rng = random.Random(4)

    def fresh(n):
        return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))

    def edit(line):
        words = line.split(" ")
        words[rng.randrange(len(words))] = "edited" + str(rng.randint(0, 9))
        return " ".join(words)
    base = [fresh(rng.randint(12, 60)) for _ in range(25)] + ["short line", "Yes."]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                line = edit(line) if len(line) > 60 else line
            text.append(rng.choice((line, "  " + line.upper(), line, fresh(10), "")))
        rows.append((doc, "\n".join(text)))
    return rows


def test_texts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).select("row.doc_id", "text", "n_lines", "n_removed").withColumnRenamed("doc_id", "doc").collect()}
    want = brute(rows)
    texts = dict(rows)
    assert {d: t for d, (t, _, _) in got.items()} == want
    for doc, (text, n, removed) in got.items():
        assert n == len(texts[doc].split("\n")) and (removed == 0) == (text == texts[doc])


def test_near_copies_of_one_line(spark):
    """A hot group of near copies, two of them linked only through others."""
    line = " ".join(f"word{k:03d}" for k in range(80))
    rows = [(k, line.replace(f"word{k:03d}", f"other{k:03d}") + f" {k:03d}") for k in range(70)] + [(900, "something else " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.dedup_lines(df).select("row.doc_id", "text").collect()}
    assert [d for d, t in left.items() if t] == [0, 900] or sorted(d for d, t in left.items() if t) == [0, 900]


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "\n\n", "a", 1), (None, "x\ny", "a", 1), (4, "X\n z", "a", 1), (4, "X\n z", "a", 1),
            (5, "x" * 100_000 + "\nx\r\n", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, kept int")
    got = lines.dedup_lines(df).select("row.*", F.col("text").alias("new")).collect()
    assert len(got) == 7
    new = [(r.doc_id, r.new) for r in got]
    assert sorted(new, key=str) == sorted([(1, None), (2, ""), (3, "\n\n"), (None, "x\ny"), (4, " z"), (4, " z"), (5, "x" * 100_000 + "\n")], key=str)
    assert lines.dedup_lines(df.where("false")).collect() == []


def test_common_passage(spark, monkeypatch):
    """Lines that hold one passage and differ in the rest are not compared with one another; near copies among them are found."""
    rng = random.Random(6)

    def fresh(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = fresh(240)
    texts = [f"{fresh(40)}x{passage}x{fresh(40)}" for _ in range(200)]
    texts += [t[:200] + "#" + t[201:] for t in texts[:40]]
    compared, verified = [], lines._verified

    def counted(pairs, *others):
        compared.append(pairs.distinct().count())
        return verified(pairs, *others)
    monkeypatch.setattr(lines, "_verified", counted)
    rows = list(enumerate(texts))
    left = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text").collect()}
    assert left == brute(rows) and [left[k] for k in range(200, 240)] == [""] * 40
    assert compared[1] < 10 * len(texts), compared


def test_frequent_line(spark, monkeypatch):
    """A line above `HOT` counts as one when keys are made, whoever holds it."""
    monkeypatch.setattr(lines, "HOT", 3)
    line = "several people walked along river banks before sunset while others stayed inside"
    rows = [(k, f"own {k}\n{line}\n{line}") for k in range(6)] + [(6, line.replace("sunset", "sumset")), (None, line + "\nz")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.doc_id is not None) == [(False, k, f"own {k}") for k in range(6)] + [(False, 6, "")]
    assert [r.text for r in got if r.doc_id is None] == [line + "\nz"]


def test_near_copies_with_many_changes(spark, monkeypatch):
    """Near copies of one line, half of them too far from it: they are not all compared with the others, and those with common changes are found."""
    rng = random.Random(11)

    def fresh(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = [fresh(5) for _ in range(60)]

    def changed(words, n):
        places = set(rng.sample(range(60), n))
        return [fresh(5) if k in places else w for k, w in enumerate(words)]
    texts = [changed(base, rng.choice((1, 2, 3, 5, 6, 7, 8))) for _ in range(240)]
    texts += [changed(words, 1) for words in texts[:60]]
    texts += [words[:rng.randint(40, 59)] for words in texts[60:100]]
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    rng.shuffle(rows)
    compared, verified = [], lines._verified

    def counted(pairs, *others):
        compared.append(pairs.distinct().count())
        return verified(pairs, *others)
    monkeypatch.setattr(lines, "_verified", counted)
    monkeypatch.setattr(lines, "FEW", 8)
    left = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text").collect()}
    assert left == brute(rows)
    assert compared[1] < 5 * len(rows), compared


def test_sketches(spark):
    rng = random.Random(2)
    sets = [([rng.randrange(-2**63, 2**63) for _ in range(90)], k) for k in (0, 1, 30, 90)]
    rows = [(s, s[k:] + [rng.randrange(-2**63, 2**63) for _ in range(k)], 2 * k) for s, k in sets]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, d int")
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(lines._bits(F.col("x")), lines._bits(F.col("y")), strict=True)), F.lit(0))
    got = [(r.d, r.apart) for r in df.select("d", apart.alias("apart")).collect()]
    assert all(apart <= d and (d - apart) % 2 == 0 and (apart > d / 2 or not d) for d, apart in got), got
