"""Near-duplicate documents by SimHash, linked through anchor points of a covering code.

Fingerprints: a bit is 1 if it is set in over half of the hashes of a text's word shingles.

Links: fingerprints that differ in few bits are found through anchors. The code is a sum
of repetition codes: the 64 bits are cut into blocks of odd length, an anchor has each
block all 0 or all 1, and bits left over are 0 in every anchor. Its covering radius is
the sum of half the blocks' lengths (and the bits left over), since each point has its
majority anchor within that. Two points at `distance` or fewer bits have a point between
them, `near` from the one and `far` from the other (near + far = distance); that point's
anchor is within the covering radius plus `near` of the one and plus `far` of the other.
So each fingerprint is replicated to the anchors that flipping up to `near` and up to
`far` of its bits can lead to, all within radius plus threshold, and compared per anchor.
This finds every pair, at any number of blocks; that number follows the number of
fingerprints, so that an anchor keeps few of them.

Copies share a fingerprint and enter once. An anchor with very many fingerprints is cut
into pairs of parts, each a group of its own. Within an anchor the links are united at
once; only a spanning forest leaves it, so a large group of near copies gives as many
rows as it has members, and no link between its parts is lost.

Null and empty texts have fingerprint zero, which links like any other. Rows with equal
ids are told apart by fingerprint only; null ids are kept and get the component of their
fingerprint. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.llm.graph import components
from textguard.llm.shipping import ship

ship(__name__)

SHINGLES_AT_ONCE = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's shingles, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits and lowers ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1))
    ends = np.append(starts[1:] - 1, len(line))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        spans = zip(starts[at: at + SHINGLES_AT_ONCE], ends[at: at + SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([digest(line[s:e], 42) for s, e in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc, th (hash of the text), fp (a signed long with the fingerprint's bits)."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("th"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc", "th", "fp"])

    return rows.mapInArrow(run, "doc long, th long, fp long")


def block_lengths(blocks: int, bits: int = 64) -> list[int]:
    """`blocks` odd lengths that add up to `bits`, or to one less."""
    base = bits // blocks
    lengths = [base - 1 + base % 2] * blocks
    for k in range((bits - sum(lengths)) // 2):
        lengths[k % blocks] += 2
    return lengths


def anchors(points: np.ndarray, lengths: list[int], flips: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the point and number of the anchor, for all majority anchors that up to
    `flips` (at most 3) flipped bits of the point can lead to."""
    bits = np.unpackbits(points.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    ones = np.add.reduceat(bits[:, : sum(lengths)], edges, axis=1, dtype=np.int64)
    half = np.array(lengths) // 2
    major = ones > half
    cost = np.where(major, ones - half, half + 1 - ones)  # flips that turn the block's majority
    weight = np.int64(1) << np.arange(len(lengths), dtype=np.int64)
    home = major @ weight
    who, where = [np.arange(len(points))], [home]

    def grow(rows: np.ndarray, at: np.ndarray, spent: np.ndarray, first: int) -> None:
        for k in range(first, len(lengths)):
            total = spent + cost[rows, k]
            fit = total <= flips
            if fit.any():
                who.append(rows[fit])
                where.append(at[fit] ^ weight[k])
                grow(rows[fit], at[fit] ^ weight[k], total[fit], k + 1)

    if flips:
        grow(np.arange(len(points)), home, np.zeros(len(points), np.int64), 0)
    return np.concatenate(who), np.concatenate(where)


def united(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable by links a-b, for n points; `root` goes on from an earlier call."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _pairs(rows_a: np.ndarray, rows_b: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of a row of a and a row of b with the same group number
    (both sorted), in bounded slices."""
    groups, first, size = np.unique(rows_b, return_index=True, return_counts=True)
    if not len(groups):
        return
    place = np.searchsorted(groups, rows_a)
    place[place == len(groups)] = 0
    n = np.where(groups[place] == rows_a, size[place], 0)
    total = np.cumsum(n)
    start = 0
    while start < len(rows_a):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + at_once, "right")))
        count = n[start:stop]
        left = np.repeat(np.arange(start, stop), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield left, first[place[left]] + inside
        start = stop


def _compare(distance: int, at_once: int = 1_000_000):
    """Links within groups of rows (group columns, side, fp) sorted by group."""
    def links(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        near, far = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        points, index = np.unique(fp, return_inverse=True)
        bits = points.view(np.uint64)
        root = np.arange(len(points))
        for i, j in _pairs(group[near], group[far], at_once):
            p, q = index[near[i]], index[far[j]]
            p, q = p[p < q], q[p < q]
            linked = np.bitwise_count(bits[p] ^ bits[q]) <= distance
            root = united(len(points), p[linked], q[linked], root)
        moved = root != np.arange(len(points))
        return pa.record_batch([pa.array(points[moved]), pa.array(points[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        rows = 0

        def columns(parts: list[tuple]) -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*parts, strict=True)]

        def numbered(cols: list[np.ndarray]) -> np.ndarray:
            change = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
            return np.concatenate(([0], np.cumsum(change)))

        for batch in batches:
            if batch.num_rows:
                kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                rows += batch.num_rows
            if rows >= 200_000:
                cols = columns(kept)
                group = numbered(cols)
                cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if cut:
                    yield links(group[:cut], cols[3][:cut], cols[4][:cut])
                kept, rows = [tuple(c[cut:] for c in cols)], 0
        if kept:
            cols = columns(kept)
            yield links(numbered(cols), cols[3], cols[4])

    return run


def linked(points: DataFrame, distance: int = 3, group_rows: int = 50_000) -> DataFrame:
    """Links (columns a, b) that connect all distinct fingerprints `fp` within `distance`
    bits of one another: a spanning forest for each anchor, not all pairs."""
    points = durable(points.select("fp").where("fp is not null").distinct())
    lengths = block_lengths(min(21, max(8, points.count().bit_length() - 1)))
    near, far = distance // 2, distance - distance // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 5000):
                some = np.ascontiguousarray(fp[at: at + 5000])
                for side, flips in ((0, near), (1, far)):
                    who, where = anchors(some.view(np.uint64), lengths, flips)
                    yield pa.record_batch([
                        pa.array(where.astype(np.int32)), pa.array(np.full(len(who), side, np.int8)), pa.array(some[who]),
                    ], ["anchor", "side", "fp"])

    placed = durable(points.mapInArrow(spread, "anchor int, side byte, fp long"))
    # Anchors with too many rows are cut on both sides; each pair of parts is a group.
    parts = placed.groupBy("anchor").agg(*[
        F.ceil(F.count_if(F.col("side") == k) / group_rows).cast("int").alias(f"n{k}") for k in (0, 1)])
    parts = durable(parts.where("n0 > 1 or n1 > 1"))
    whole = F.array(F.lit(0))
    own = F.array(F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    all_of = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)
    if parts.isEmpty():
        cut = placed.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "side", "fp")
    else:
        cut = placed.join(parts, "anchor", "left").select(
            "anchor", "side", "fp",
            F.when(F.col("n0").isNull(), whole).when((F.col("n0") > 0) & (F.col("n1") > 0), F.when(F.col("side") == 0, own).otherwise(all_of)).alias("i"),
            F.when(F.col("n0").isNull(), whole).when((F.col("n0") > 0) & (F.col("n1") > 0), F.when(F.col("side") == 1, own).otherwise(all_of)).alias("j"))
        cut = cut.select("anchor", F.explode("i").alias("i"), "j", "side", "fp").select(
            "anchor", "i", F.explode("j").alias("j"), "side", "fp")
    return cut.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(
        _compare(distance), "a long, b long")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links lead to)."""
    rows = durable(fingerprints(docs, doc, text, shingle))
    first = rows.groupBy("fp").agg(F.min("doc").alias("first"))
    classes = components(linked(first, distance))
    tops = classes.join(first, classes.id == first.fp).select("fp", "root", "first")
    least = tops.groupBy("root").agg(F.min("first").alias("component"))
    named = first.join(tops.join(least, "root").select("fp", "component"), "fp", "left").select(
        "fp", F.coalesce("component", "first").alias("component"))
    return rows.join(named, "fp").select(
        F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of `docs` with one row per component: the one with the smallest id (null ids last)."""
    rows = durable(fingerprints(docs, doc, text, shingle))
    classes = components(linked(rows, distance))
    by_fp = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th")).alias("least"))
    least = by_fp.join(classes, by_fp.fp == classes.id, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("least").alias("least"))
    keep = least.select(F.col("least.doc").alias("doc"), F.col("least.th").alias("th"))
    whole = docs.select(F.struct("*").alias("row"), F.col(doc).cast("long").alias("doc"),
                        F.xxhash64(F.col(text).cast("string")).alias("th"))
    found = whole.alias("w").join(keep.alias("k"), F.col("w.doc").eqNullSafe(F.col("k.doc")) & (F.col("w.th") == F.col("k.th")), "left_semi")
    return found.dropDuplicates(["doc", "th"]).select("row.*")
