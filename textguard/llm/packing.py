"""Packing of tokenized documents into sequences of bounded length.

A document's ids (and an end id) are cut into full windows, which are sequences of their
own, and a rest. Rests are packed by best-fit decreasing: longest first, each into the
open sequence with the least room that still takes it, which a segment tree over the
room left finds in as many steps as the window has bits. Only numbers are shuffled: each
piece's length and place; pieces are dealt to groups of bounded size in turn, whatever
their document, and each group is packed by one task.

Null texts are empty, so they give the end id alone. Equal rows are packed one by one,
null ids as well. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.llm.shipping import ship
from textguard.llm.tokens import tokenizer

ship(__name__)

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Room:
    """Segment tree over the rooms 0..window: how many open sequences have that much left."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        """The least room of `need` or more that an open sequence has; -1 if none has it."""
        count, at = self.count, need + self.size
        if count[at]:
            return need
        while at > 1:  # up to the first right neighbour with an open sequence
            if not at & 1 and count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.size:
            at *= 2
            if not count[at]:
                at += 1
        return at - self.size


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset for each piece; lengths come longest first."""
    tree, opened = Room(window), [[] for _ in range(window + 1)]
    sequence, offset, made = [], [], 0
    for need in lengths:
        room = tree.least(need)
        if room < 0:
            number, room, made = made, window, made + 1
        else:
            number = opened[room].pop()
            tree.add(room, -1)
        sequence.append(number)
        offset.append(window - room)
        if room > need:
            opened[room - need].append(number)
            tree.add(room - need, 1)
    return sequence, offset


def pieces(docs: DataFrame, path: str, window: int = 2048, end: int = 1, doc: str = "doc_id", text: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document: full windows, then the rest; with the ids if asked for."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, sizes = encoder.encode(texts)
                ends = np.cumsum(sizes)
                out = ([], [], [], [], [], [])
                for d, (stop, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    own = np.append(ids[stop - size: stop], end).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start: start + window]
                        for column, value in zip(out, (d, start, len(piece), zlib.crc32(piece.tobytes()), len(own), piece), strict=True):
                            column.append(value)
                columns = [part.column(0).take(pa.array(out[0], pa.int64())), *[pa.array(c, pa.int64()) for c in out[1:5]]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in out[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(columns, names)

    return rows.mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


def packed(cut: DataFrame, window: int = 2048, group_rows: int = 50_000) -> DataFrame:
    """Pieces with sequence_id, offset in the sequence, and padded: the length it is padded
    to, which is the window unless the sequence's own length is a power of two."""
    cut = durable(cut.withColumn("row", F.monotonically_increasing_id()))  # numbers are stored: reads may be split in any way
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))

    def run(table: pa.Table) -> pa.Table:
        row, length = table["row"].to_numpy(), table["length"].to_numpy()
        order = np.lexsort((row, -length))
        sequence, offset = best_fit(length[order].tolist(), window)
        sequence = np.array(sequence, np.int64)
        used = np.bincount(sequence, weights=length[order]).astype(np.int64)
        padded = np.where(used & (used - 1) == 0, used, window)
        group = np.int64(table["group"][0].as_py()) << 32
        return pa.table({"row": row[order], "sequence_id": group + sequence, "offset": np.array(offset, np.int64),
                         "padded": padded[sequence]})

    placed = dealt.groupBy("group").applyInArrow(run, "row long, sequence_id long, offset long, padded long")
    return cut.join(placed, "row").drop("row")


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1, doc: str = "doc_id", text: str = "text",
         keep_ids: bool = False, group_rows: int = 50_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset, padded."""
    return packed(pieces(docs, path, window, end, doc, text, keep_ids), window, group_rows)


def sequences(piece_rows: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids (padded), used."""
    whole = piece_rows.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used"),
        F.first("padded").alias("padded"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    fill = F.array_repeat(F.lit(pad), (F.col("padded") - F.col("used")).cast("int"))
    return whole.select("sequence_id", F.concat(ids, fill).alias("ids"), "used")
