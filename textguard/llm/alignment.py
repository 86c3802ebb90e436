"""Alignment of two tokenizers' tokens, counted through inverted bitmaps of documents.

A document's text with a blank in front is encoded by a byte-level BPE vocabulary (A) and
by a SentencePiece model (B). Byte offsets where tokens of both end cut it into groups; the
two tokens that end at such a place are linked. An id pair's count is the number of its
links in the whole corpus.

Counts come from an inverted index. Documents are numbered by block and place. For each
pair and block there is one posting: bitmaps over the places, one per binary digit of how
often the pair is linked there (multiplicity planes). A bitmap is stored as its sorted
places, or as bits where that is shorter. Planes OR-merged give the pair's documents, whose
bits are counted; bits of the planes, weighted by their digit, give its links; blocks have
no place in common, so their counts are added by a partial aggregation and a hot pair is
never gathered. Then postings return scores: each meets its pair's count and goes back to
its block, where the planes say which document gets it how often.

Blocks are bounded by documents and by links, so no task holds more than one of them,
whatever source or text is hot. Numbers are written with the postings, once, and read from
there, so recomputed tasks see the same ones.

Texts are encoded by units, cut before blanks that no token of either side spans; a worker
keeps a bounded number of units with their ids, groups and links. Texts that are null or
empty, or whose tokens' bytes differ from the blank and the text, have no tokens (a text
with U+2581 is one, since B reads it as a blank). Special tokens' strings are plain text.
Each row is a document, so repeated rows count as often as they stand there; ids of
documents may be null or repeat. Only the named columns are read; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.llm.shipping import broadcast_file, ship, worker_cache
from textguard.llm.tokens import byte_symbols

ship(__name__)

#: A block has so many documents and, beyond its first one, so many links at most.
DOCS = 4096
LINKS = 3_000_000
#: Bits of a document's place in a block, and of an id.
_PLACE, _ID = 12, 24
#: Bitmaps with so many places are stored as bits (in as many bytes as twice that number).
_DENSE = DOCS // 16
#: Cuts: the blank follows a character that is none, and white space stands on one side only.
_CUT = re.compile(r"(?<=\S)(?= [^ ])|(?<=[^ ])(?= \S)")
_WIDE = re.compile(r"\s \s|  ")


def units_of(text: str) -> list[str]:
    """A blank and the text, in parts that both tokenizers encode alone as they do together."""
    if text[-1] != " " and not _WIDE.search(" " + text):
        return [" " + part for part in text.split(" ")]
    return _CUT.split(" " + text)


class _Numbers(dict):
    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class Aligner:
    """Tokens, groups and links of texts; `units` and `chars` bound what is remembered."""

    def __init__(self, a: bytes, b: bytes, units: int = 400_000, chars: int = 2**24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        value = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        vocabulary = json.loads(a)["model"]["vocab"]
        self.a_bytes = {k: bytes(value[c] for c in token) for token, k in vocabulary.items() if all(c in value for c in token)}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(k)]]
        if max(max(self.a_bytes), len(self.b_bytes)) >= 2**_ID:
            raise ValueError(f"ids of {_ID} bits at most")
        self.a_lengths, self.b_lengths = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(v) for v in self.b_bytes], np.int64)
        for k, token in self.a_bytes.items():
            self.a_lengths[k] = len(token)
        # An id with what may stand behind it: another id of its side, or the end of its side of the group.
        self.first_b = 2 * len(self.a_lengths)
        self.marks = [f"{k}{end}" for k in range(len(self.a_lengths)) for end in ",|"] + [f"{k}{end}" for k in range(len(self.b_bytes)) for end in ",;"]
        self.mark_lengths = np.array([len(m) for m in self.marks], np.int64)
        self.limits = units, chars
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars, self.groups = _Numbers(), 0, []
        self.counts = np.zeros((0, 4), np.int64)  # per unit: tokens of A, of B, groups, whether the bytes are right
        self.starts, self.lengths, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        self.chars += sum(map(len, units))
        raw = [u.encode() for u in units]
        # Units that end in no white space give the same ids one after the other in one call.
        whole = [k for k, u in enumerate(units) if not u[-1].isspace()]
        rest = [k for k, u in enumerate(units) if u[-1].isspace()]
        order = [*whole, *rest]
        texts = ["".join([units[k] for k in whole]), *[units[k] for k in rest]]
        ids_a = list(chain.from_iterable(one.ids for one in self.a.encode_batch_fast(texts, add_special_tokens=False)))
        ids_b = list(chain.from_iterable(self.b.encode([units[k][1:] for k in order], num_threads=1)))
        text = b"".join([raw[k] for k in order])
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) == text == b"".join(map(self.b_bytes.__getitem__, ids_b)):
            found = self._together(np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.array([len(raw[k]) for k in order], np.int64))
        else:
            found = self._one_by_one([units[k] for k in order], [raw[k] for k in order])
        counts, groups, lengths, links = found
        back = np.argsort(np.array(order, np.int64))  # from places in `order` to units
        self.groups += map(groups.__getitem__, back.tolist())
        self.counts = np.concatenate([self.counts, counts[back]])
        self.starts = np.concatenate([self.starts, (np.cumsum(lengths) - lengths)[back] + len(self.links)])
        self.lengths = np.concatenate([self.lengths, lengths[back]])
        self.links = np.concatenate([self.links, links])

    def _together(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts, groups, numbers of links and links of units of these sizes, from all their tokens."""
        end_a, end_b, end = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b]), np.cumsum(sizes)
        at = np.searchsorted(end_b, end_a)
        cut_a = end_b[at] == end_a
        cut_b = np.zeros(len(b), bool)
        cut_b[at[cut_a]] = True
        links = a[cut_a] << _ID | b[cut_b]
        # Groups are written one after the other: A's tokens, then B's, each with the mark behind it.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        marks = np.empty(len(a) + len(b), np.int64)
        marks[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + cut_a
        marks[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.first_b + 2 * b + cut_b
        text = "".join(map(self.marks.__getitem__, marks.tolist()))
        upto = [np.searchsorted(ends, end) + 1 for ends in (end_a, end_b, end_a[cut_a])]
        chars = np.cumsum(self.mark_lengths[marks])[upto[0] + upto[1] - 1]
        groups = [text[lo: hi - 1] for lo, hi in zip([0, *chars[:-1].tolist()], chars.tolist(), strict=True)]
        n_a, n_b, n_groups = (np.diff(x, prepend=0) for x in upto)
        return np.stack([n_a, n_b, n_groups, np.ones_like(n_a)], 1), groups, n_groups, links

    def _one_by_one(self, units: list[str], raw: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """The same where some unit's tokens do not give its bytes."""
        counts, groups, lengths, links = [], [], [], [np.zeros(0, np.int64)]
        for unit, own in zip(units, raw, strict=True):
            a, b = self.a.encode(unit, add_special_tokens=False).ids, self.b.encode(unit[1:])
            if b"".join(map(self.a_bytes.__getitem__, a)) == own == b"".join(map(self.b_bytes.__getitem__, b)):
                count, text, n, link = self._together(np.array(a, np.int64), np.array(b, np.int64), np.array([len(own)]))
            else:
                count, text, n, link = np.zeros((1, 4), np.int64), [""], [0], np.zeros(0, np.int64)
            counts.append(count)
            groups += text
            lengths += list(n)
            links.append(link)
        return np.concatenate(counts), groups, np.array(lengths, np.int64), np.concatenate(links)

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Per text its numbers of A and B tokens and of groups, its groups, and its links (`a << 24 | b`)."""
        if len(self.numbers) > self.limits[0] or self.chars > self.limits[1]:
            self._forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        found = []
        for text in texts:
            units = units_of(text) if text and "▁" not in text else []
            found.append(np.fromiter(map(number, units), np.int64, len(units)))
        if len(self.numbers) > known:
            self._learn(list(self.numbers)[known:])
        for own in found:
            n_a, n_b, n_groups, good = self.counts[own].sum(0).tolist()
            if not len(own) or good < len(own):
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            n = self.lengths[own]
            ends = np.cumsum(n)
            links = self.links[np.repeat(self.starts[own] - ends + n, n) + np.arange(int(ends[-1]))]
            yield n_a, n_b, n_groups, ";".join(map(self.groups.__getitem__, own.tolist())), links


def planes_of(links: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The pairs of a block's links (`a << 24 | b`), and per pair its multiplicity planes:
    bitmap k holds the places that have the pair a number of times with binary digit k."""
    keys = np.sort(links << _PLACE | places)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(first, append=len(keys))
    keys = keys[first]
    pair_of, place = keys >> _PLACE, keys & (DOCS - 1)
    head = np.flatnonzero(np.diff(pair_of, prepend=-1))
    pairs, row = pair_of[head], np.cumsum(np.diff(pair_of, prepend=-1) != 0) - 1
    digits = np.frexp(np.maximum.reduceat(times, head).astype(float))[1].astype(np.int64) if len(head) else head
    base = np.cumsum(digits) - digits
    bitmap, member = [], []
    for k in range(int(digits.max()) if len(digits) else 0):
        some = np.flatnonzero(times >> k & 1)
        bitmap.append(base[row[some]] + k)
        member.append(place[some])
    bitmap, member = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (bitmap, member))
    order = np.argsort(bitmap, kind="stable")  # places stay in order
    bitmap, member = bitmap[order], member[order]
    count = np.bincount(bitmap, minlength=int(digits.sum()))
    begin = np.cumsum(count) - count
    size = np.where(count >= _DENSE, _DENSE, count)  # in units of two bytes
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), "<u2")
    thin = count[bitmap] < _DENSE
    data[(at[bitmap] + np.arange(len(bitmap)) - begin[bitmap])[thin]] = member[thin]
    for k in np.flatnonzero(count >= _DENSE).tolist():
        bits = np.zeros(DOCS, np.uint8)
        bits[member[begin[k]: begin[k] + count[k]]] = 1
        data[at[k]: at[k] + _DENSE] = np.packbits(bits, bitorder="little").view("<u2")
    offsets = np.concatenate([2 * at, [2 * len(data)]]).astype(np.int32)
    bitmaps = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pairs, pa.ListArray.from_arrays(pa.array(np.concatenate([base, [len(count)]]), pa.int32()), bitmaps)


def places_in(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All members of postings' bitmaps: the posting's number, the plane, the place."""
    bitmaps = planes.flatten()
    lengths = np.diff(planes.offsets.to_numpy())
    posting = np.repeat(np.arange(len(planes)), lengths)
    plane = np.arange(len(bitmaps)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32, len(bitmaps) + 1, bitmaps.offset * 4).astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    thin = np.flatnonzero(size < 2 * _DENSE)
    count = size[thin] // 2
    ends = np.cumsum(count)
    at = np.repeat(offsets[thin] - 2 * (ends - count), count) + 2 * np.arange(int(ends[-1]) if len(ends) else 0)
    place, of = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8, np.repeat(thin, count)
    dense = np.flatnonzero(size == 2 * _DENSE)
    if len(dense):
        bits = np.unpackbits(data[offsets[dense][:, None] + np.arange(2 * _DENSE)], axis=1, bitorder="little")
        which, more = np.nonzero(bits)
        of, place = np.concatenate([of, dense[which]]), np.concatenate([place, more])
    return posting[of], plane[of], place


_FIELDS = [("kind", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
           ("n_links", pa.int64()), ("groups", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("planes", pa.list_(pa.binary()))]


def index(docs: DataFrame, path_a: str, path_b: str, doc: str = "doc_id", text: str = "text",
          keep: Callable[[Column], Column] = lambda groups: groups) -> tuple[DataFrame, DataFrame]:
    """Documents: doc_id, block, place, n_a, n_b, n_groups, n_links, groups (`keep` may make
    something shorter of the text before it is stored); and postings: a, b, block, planes."""
    spark = docs.sparkSession
    file_a, file_b = broadcast_file(spark, path_a), broadcast_file(spark, path_b)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, cache = (file_a.value, file_b.value), worker_cache("alignment")
        key = tuple(hashlib.sha256(r).digest() for r in raw)
        if key not in cache:
            cache[key] = Aligner(*raw)
        aligner = cache[key]
        block, place, held, places = TaskContext.get().partitionId() << 32, 0, [], []
        id_type = None

        def record(n: int, **columns) -> pa.RecordBatch:
            given = {"kind": pa.array(np.full(n, "a" in columns), pa.int32()), **columns}
            fields = [("doc_id", id_type), *_FIELDS]
            return pa.record_batch([given.get(name, pa.nulls(n, kind)) for name, kind in fields], schema=pa.schema(fields))

        def postings() -> Iterator[pa.RecordBatch]:
            pairs, planes = planes_of(np.concatenate(held), np.repeat(places, [len(h) for h in held]))
            for at in range(0, len(pairs), 20_000):
                some = pairs[at: at + 20_000]
                yield record(
                    len(some), block=pa.array(np.full(len(some), block), pa.int64()), a=pa.array(some >> _ID, pa.int32()),
                    b=pa.array(some & (2**_ID - 1), pa.int32()), planes=planes.slice(at, 20_000))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                out = []
                for n_a, n_b, n_groups, groups, links in aligner.align(some.column(1).to_pylist()):
                    if place == DOCS or (held and sum(map(len, held)) + len(links) > LINKS):
                        if held:
                            yield from postings()
                        block, place, held, places = block + 1, 0, [], []
                    out.append((block, place, n_a, n_b, n_groups, len(links), groups))
                    if len(links):
                        held.append(links)
                        places.append(place)
                    place += 1
                names = [name for name, _ in _FIELDS[1:8]]
                columns = {name: pa.array(values, kind) for (name, kind), values in zip(_FIELDS[1:8], zip(*out, strict=True), strict=True)}
                assert list(columns) == names
                yield record(some.num_rows, doc_id=some.column(0), **columns)
        if held:
            yield from postings()

    kinds = ("doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", kind int, block long, place int, n_a long, n_b long, n_groups long, "
             "n_links long, groups string, a int, b int, planes array<binary>")
    found = rows.mapInArrow(run, kinds).withColumn("groups", keep(F.col("groups")))
    stored = durable(found, "kind")
    return (stored.where("kind = 0").select("doc_id", "block", "place", "n_a", "n_b", "n_groups", "n_links", "groups"),
            stored.where("kind = 1").select("a", "b", "block", "planes"))


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, links (how often the pair is linked) and docs (in how many documents), from the bitmaps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posting, plane, place = places_in(batch.column(2))
            n = batch.num_rows
            links = np.zeros(n, np.int64)
            np.add.at(links, posting, np.int64(1) << plane)
            docs = np.bincount(posting[plane == 0], minlength=n)  # planes OR-merged: those with one plane are there
            some = np.flatnonzero((np.bincount(posting, plane > 0, minlength=n) > 0)[posting])
            if len(some):
                merged = np.unique(posting[some] << _PLACE | place[some]) >> _PLACE
                several = np.bincount(merged, minlength=n)
                docs = np.where(several > 0, several, docs)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(links), pa.array(docs, pa.int64())], ["a", "b", "links", "docs"])

    counted = postings.select("a", "b", "planes").mapInArrow(run, "a int, b int, links long, docs long")
    return counted.groupBy("a", "b").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))


def scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per document with links: block, place, n_best (links whose pair has its B id's highest
    count) and count_sum (the counts of all its links)."""
    tops = pairs.groupBy("b").agg(F.max("links").alias("top"))
    rated = pairs.join(tops, "b").select("a", "b", "links", (F.col("links") == F.col("top")).alias("best"))
    met = postings.join(rated, ["a", "b"]).select("block", "planes", "links", "best")

    def run(table: pa.Table) -> pa.Table:
        totals = np.zeros((DOCS, 3), np.int64)
        for batch in table.to_batches():
            posting, plane, place = places_in(batch.column(1))
            times = np.int64(1) << plane
            best = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.stack([times * best[posting], times * batch.column(2).to_numpy()[posting], times], 1)
            np.add.at(totals, place, values)
        found = np.flatnonzero(totals[:, 2])
        return pa.table({
            "block": pa.array(np.full(len(found), table.column(0)[0].as_py()), pa.int64()), "place": pa.array(found, pa.int32()),
            "n_best": pa.array(totals[found, 0]), "count_sum": pa.array(totals[found, 1])})

    return met.groupBy("block").applyInArrow(run, "block long, place int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, doc: str = "doc_id", text: str = "text",
          keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (as `keep` leaves them)."""
    documents, postings = index(docs, path_a, path_b, doc, text, keep)
    found = scores(postings, durable(pair_counts(postings)))
    both = documents.join(found, ["block", "place"], "left")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups")
