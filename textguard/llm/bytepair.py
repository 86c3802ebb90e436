"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read on the driver and broadcast (a vocabulary: a file of more than
64 MB is refused); each Python worker builds one encoder from it. A long text
is cut before it reaches the library, so that no call gets more than about `AT_MOST`
characters at once. Cuts are made only where a match of the splitting pattern ends
whatever stands around it (`SAFE`): behind a character that is no white space and before
white space, or between two ASCII classes of which no match holds one behind the other.
Where there is no such place, the stretch goes to the library whole. Ids of the parts one
after the other are the ids of the text. Decoding joins the bytes of the ids; they need
not be valid UTF-8.

Special tokens have no meaning here: their strings are ordinary text. Null texts give a
null list of ids, empty ones an empty list; a null list has null bytes. Rows are looked at
one by one, so ties and repeated rows get equal results; only the named columns are read,
and an empty table gives an empty table. Ids that the rank file lacks are an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.shipping import broadcast_file, ship, worker_cache

ship(__name__)

AT_MOST = 100_000
_PUNCTUATION = r"!-/:-@\[-`{-~"
#: Places no match of the pattern spans. A quote before letters is left out: `'s` is one match.
SAFE = re.compile(
    rf"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9{_PUNCTUATION}])|(?<=[0-9])(?=[A-Za-z{_PUNCTUATION}])|(?<=[{_PUNCTUATION}])(?=[0-9])")


def parts(text: str, at_most: int = AT_MOST) -> Iterator[str]:
    """The text in parts of about `at_most` characters, cut at safe places only."""
    start = 0
    while len(text) - start > at_most:
        cut = SAFE.search(text, start + at_most)
        if cut is None:
            break
        yield text[start: cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank per token; a line holds the token's bytes in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, raw.splitlines()))}


class Codec:
    """Ids of texts and bytes of ids."""

    def __init__(self, raw: bytes, pattern: str):
        from tiktoken import Encoding

        self.library = Encoding(hashlib.sha256(raw).hexdigest(), pat_str=pattern, mergeable_ranks=read_ranks(raw), special_tokens={})

    def encode(self, text: str, at_most: int = AT_MOST) -> np.ndarray:
        if len(text) <= at_most:
            return np.array(self.library.encode_ordinary(text), np.int32)
        return np.concatenate([np.array(self.library.encode_ordinary(part), np.int32) for part in parts(text, at_most)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


def _codec(raw: bytes, pattern: str) -> Codec:
    cache = worker_cache("byte_bpe")
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in cache:
        cache[key] = Codec(raw, pattern)
    return cache[key]


def encode(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of each text by the rank file at `path` and the splitting pattern."""
    shared = broadcast_file(docs.sparkSession, path)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column(1).to_pylist()
                ids = [codec.encode(t or "") for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                mask = pa.array([t is None for t in texts], pa.bool_())
                yield pa.record_batch([some.column(0), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()), mask=mask)], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, n_tokens, packed (the ids as little-endian unsigned 32-bit integers, as files of
    training data hold them), raw (the bytes the ids stand for)."""
    shared = broadcast_file(rows.sparkSession, path)
    rows = rows.select(F.col(doc).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            own = [values[a:b] if ok else None for a, b, ok in zip(
                offsets[:-1], offsets[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([
                batch.column(0), pa.array([0 if i is None else len(i) for i in own], pa.int64()),
                pa.array([None if i is None else i.astype("<u4").tobytes() for i in own], pa.binary()),
                pa.array([None if i is None else codec.decode(i) for i in own], pa.binary())], ["doc_id", "n_tokens", "packed", "raw"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, packed binary, raw binary")
