"""Revisits against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from textguard.llm import warc

SCHEMA = "record_id long, url string, ts long, type string, headers map<string,string>, canonical_url string, outcome int"


def plain(records):
    out = {}
    for rid, url, ts, kind, headers in records:
        if kind != "revisit":
            continue
        fresh = {k.lower(): v for k, v in (headers or {}).items()}
        before = [(t, r, {k.lower(): v for k, v in (h or {}).items()}) for r, u, t, k, h in records
                  if k == "response" and u == url and url is not None and ts is not None and t is not None and (t, r) < (ts, rid)]
        if not before:
            out[rid] = ("no_response", None, None)
            continue
        _, ref, stored = max(before, key=lambda x: x[:2])
        tag = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
        pairs = [(tag(stored), tag(fresh)), (stored.get("last-modified"), fresh.get("last-modified"))]
        outcome = next(("resolved" if a == b else "changed" for a, b in pairs if a is not None and b is not None), "unverified")
        merged = {**stored, **{k: v for k, v in fresh.items() if k not in warc.BODY_HEADERS}} if outcome == "resolved" else None
        out[rid] = (outcome, ref, merged)
    return out


@pytest.mark.parametrize("spans", [256, 3])
def test_resolution(spark, spans):
    rng = random.Random(spans)
    records = []
    for rid in range(1500):
        url = "hot.example/x" if rid % 3 else rng.choice(["a.example/1", "a.example/2", "b.example", None])
        ts = rng.choice([rng.randint(0, 400), 77, 77, None if rid % 50 == 0 else 3])
        headers = {rng.choice(["ETag", "etag"]): rng.choice(['"1"', 'W/"1"', '"2"'])} if rng.random() < 0.6 else {}
        if rng.random() < 0.6:
            headers["Last-Modified"] = rng.choice(["mon", "tue"])
        headers["X-Seen"] = str(rid)
        if rng.random() < 0.3:
            headers["Content-Length"] = str(rid)
        records.append((rid, url, ts, rng.choice(["response", "revisit", "revisit", "request"]), headers if rng.random() < 0.95 else None))
    df = spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA)
    got = {r.record_id: (r.outcome, r.refers_to, r.headers) for r in warc.resolve_revisits(df, spans=spans).collect()}
    assert got == plain(records)
    assert {o for o, _, _ in got.values()} == {"resolved", "changed", "unverified", "no_response"}


def test_canonical_url(spark):
    same = ["http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2", "example.com/a/?a=1&b=2&ref=y",
            " https://user:pw@www2.example.com:443/a?b=2&a=1&gclid "]
    other = ["http://example.com/A?a=1&b=2", "http://example.com/a", "http://m.example.com/a?a=1&b=2", "http://example.com:8080/a?a=1&b=2", ""]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None]], "url string")
    got = [r[0] for r in df.select(warc.canonical_url(F.col("url"))).collect()]
    assert set(got[:4]) == {"example.com/a?a=1&b=2"} and len(set(got)) == 7 and got[-1] is None


def test_empty_and_repeated(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "u", 1, "response", {"ETag": "a"}, "x", 1)] * 2 + [(2, "u", 1, "revisit", {"ETag": "a"}, "x", 1)] * 2
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.outcome, r.refers_to) for r in got] == [("resolved", 1)] * 2
