"""SentencePiece encoding by suffix-array matching, and decoding.

The texts of a batch are cut into units before each run of blanks, which no piece
crosses; the units that the worker has not met are put one after the other and indexed:
their suffixes are sorted to the depth of the longest piece, every piece's occurrences
are a range found by binary search, and the ranges' members are edges from a start to an
end. Edges are sorted by the place of their end in their unit and relaxed place by place,
for all units at once.

For a byte-pair model, a place keeps the one edge whose piece may follow the piece kept
at its start: two neighbours stand in the model's own segmentation if no merge across
their border would have come before the merges that made them (`_follows`). For a unigram
model (`kind="unigram"`), it keeps the edge with the best sum of scores. Characters that
the model does not have become their UTF-8 bytes. Ids equal those of the library.

Null texts give a null list, empty ones an empty list. Rows are looked at one by one:
ties and repeated rows get equal lists. Only the named columns are read; an empty table
gives an empty table. A worker remembers a bounded number of units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.shipping import ship, worker_cache

ship(__name__)

BLANK = "▁"
_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*")
_LATE = np.int64(2**40)


class _Numbers(dict):
    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class Model:
    """Pieces, scores and merges of a SentencePiece model."""

    def __init__(self, path: str, kind: str = "bpe"):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.kind = kind
        pieces = [library.id_to_piece(k) for k in range(size)]
        usual = [k for k in range(size) if not (
            library.is_byte(k) or library.is_control(k) or library.is_unknown(k) or library.is_unused(k))]
        self.text = {k: pieces[k] for k in usual}
        self.score = np.array([library.get_score(k) for k in range(size)])
        self.byte = np.zeros(256, np.int32)
        for k in range(size):
            if library.is_byte(k):
                self.byte[int(pieces[k][1:-1], 16)] = k
        for piece in self.text.values():
            if re.search(f"[^{BLANK}]{BLANK}", piece):
                raise ValueError(f"a piece goes on after a blank: {piece!r}")
        self.longest = max(map(len, self.text.values()))
        # Pieces as rows of character numbers (from 1; 0 behind the end), the characters by code point.
        self.chars = np.array(sorted({ord(c) for piece in self.text.values() for c in piece}), np.uint32)
        self.ids = np.array(usual, np.int64)
        self.sizes = np.array([len(self.text[k]) for k in usual], np.int64)
        flat = np.frombuffer("".join(self.text[k] for k in usual).encode("utf-32-le"), np.uint32)
        self.rows = np.zeros((len(usual), self.longest), np.int64)
        self.rows[np.arange(self.longest) < self.sizes[:, None]] = np.searchsorted(self.chars, flat) + 1
        self._decoding(pieces, usual)
        if kind == "bpe":
            self._merges(size)

    def _decoding(self, pieces: list[str], usual: list[int]) -> None:
        raw = [b""] * len(pieces)
        for k in usual:
            raw[k] = pieces[k].replace(BLANK, " ").encode()
        for value, k in enumerate(self.byte):
            raw[k] = bytes([value]) if k else raw[k]
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _merges(self, size: int) -> None:
        """Per piece its rank (single characters 0), the two parts of its last merge, and
        whether merging its characters gives it; and all pairs that merge into a piece."""
        number = {piece: k for k, piece in self.text.items()}
        order = sorted((k for k in self.text if len(self.text[k]) > 1), key=lambda k: -self.score[k])
        self.rank = np.zeros(size + 1, np.int64)
        self.rank[order] = np.arange(1, len(order) + 1)
        self.left, self.right = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        self.whole = np.zeros(size + 1, bool)
        pairs = []
        for piece, k in number.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a * 65536 + b, k))
            parts = [number.get(c) for c in piece]
            if None in parts:
                raise ValueError(f"a character of {piece!r} is not a piece")
            while len(parts) > 1:
                found = [(self.rank[c], i) for i in range(len(parts) - 1)
                         if (c := number.get(self.text[parts[i]] + self.text[parts[i + 1]])) is not None]
                if not found:
                    break
                _, i = min(found)
                last = parts[i: i + 2]
                parts[i: i + 2] = [number[self.text[last[0]] + self.text[last[1]]]]
            if len(parts) == 1:
                self.whole[k] = True
                if len(piece) > 1:
                    self.left[k], self.right[k] = last
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.pair_rank = self.rank[np.array([k for _, k in pairs], np.int64)]

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a. From the border, the merges that made the two are
        undone, latest first (of equal ones the right one, since merging goes from the left);
        at each stage, the two parts at the border must not merge before what was undone."""
        good = np.ones(len(a), bool)
        rows, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), _LATE)
        while len(rows):
            key = x * 65536 + y
            at = np.searchsorted(self.pair, key)
            at[at == len(self.pair)] = 0
            bad = (self.pair[at] == key) & (self.pair_rank[at] < limit)
            good[rows[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~bad & ((rank_x > 0) | (rank_y > 0))
            rows, x, y, rank_x, rank_y = rows[go], x[go], y[go], rank_x[go], rank_y[go]
            undo_x = rank_x > rank_y
            limit = np.where(undo_x, rank_x, rank_y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return good

    def index(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pieces of all occurrences of pieces in the text `codes` (numbers of
        characters, 0: none), through its suffixes sorted to the depth of the longest piece."""
        present = np.unique(codes)
        present = present[present > 0]
        local = np.zeros(len(self.chars) + 1, np.uint64)  # few characters take few bits
        local[present] = np.arange(1, len(present) + 1)
        bits = max(1, len(present).bit_length())
        each = 63 // bits
        padded = np.concatenate([local[codes], np.zeros(self.longest + each, np.uint64)])
        keys = []
        for first in range(0, self.longest, each):
            key = np.zeros(len(codes), np.uint64)
            for k in range(each):
                key = (key << np.uint64(bits)) | padded[first + k: first + k + len(codes)]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [key[suffixes] for key in keys]
        pieces = local[self.rows]
        possible = ((pieces > 0) | (np.arange(self.longest) >= self.sizes[:, None])).all(1)
        pieces, sizes, ids = pieces[possible], self.sizes[possible], self.ids[possible]
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), len(codes), np.int64)
        for level, key in enumerate(keys):
            part = pieces[:, level * each: (level + 1) * each]
            least = np.zeros(len(ids), np.uint64)
            for k in range(each):
                least = (least << np.uint64(bits)) | (part[:, k] if k < part.shape[1] else np.uint64(0))
            spare = (each - np.clip(sizes - level * each, 0, each)).astype(np.uint64) * np.uint64(bits)
            most = least | ((np.uint64(1) << spare) - np.uint64(1))
            if level == 0:
                low, high = np.searchsorted(key, least, "left"), np.searchsorted(key, most, "right")
                continue
            for k in np.flatnonzero((sizes > level * each) & (low < high)).tolist():
                some = key[low[k]: high[k]]
                low[k], high[k] = low[k] + np.searchsorted(some, least[k], "left"), low[k] + np.searchsorted(some, most[k], "right")
        n = high - low
        ends = np.cumsum(n)
        start = suffixes[np.repeat(low - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)]
        return start, start + np.repeat(sizes, n), np.repeat(ids, n)

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many belong to each."""
        chars = np.frombuffer("\n".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(u) for u in units], np.int64)
        unit_start = np.cumsum(lengths + 1) - lengths - 1
        at = np.searchsorted(self.chars, chars)
        at[at == len(self.chars)] = 0
        border = np.zeros(len(chars), bool)
        border[unit_start[1:] - 1] = True
        codes = np.where((self.chars[at] == chars) & ~border, at + 1, 0)
        start, end, piece = self.index(codes)
        if self.kind == "bpe":
            usable = self.whole[piece]
            start, end, piece = start[usable], end[usable], piece[usable]
        # Places are counted from the start of each run of known characters.
        known = codes > 0
        run_start = np.maximum.accumulate(np.where(known, -1, np.arange(len(chars)))) + 1
        place = end - run_start[start]
        order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 65536 else place, kind="stable")
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        cuts = np.searchsorted(place, np.arange(1, (int(place[-1]) if len(place) else 0) + 2))
        kept = np.full(len(chars) + 1, -1, np.int64)
        best = np.zeros(len(chars) + 1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
            if self.kind == "bpe":
                first = s == run_start[s]
                before = kept[s]
                fits = first.copy()
                some = np.flatnonzero(~first & (before >= 0))
                fits[some] = self._follows(before[some], p[some])
                kept[e[fits]] = p[fits]
            else:
                total = np.where(s == run_start[s], 0.0, best[s]) + self.score[p]
                by_end = np.lexsort((-total, e))
                top = by_end[np.flatnonzero(np.diff(e[by_end], prepend=-1))]
                kept[e[top]], best[e[top]] = p[top], total[top]
        return self._read(chars, known, kept, unit_start, lengths)

    def _read(self, chars: np.ndarray, known: np.ndarray, kept: np.ndarray, unit_start: np.ndarray,
              lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept pieces from each unit's end back to its start."""
        size = np.array([len(self.text.get(k, "")) for k in range(len(self.score))], np.int64)
        at, units = unit_start + lengths, np.arange(len(lengths))
        found_unit, found_at, found_id = [], [], []
        while True:
            go = at > unit_start[units]
            at, units = at[go], units[go]
            if not len(at):
                break
            good = known[at - 1]
            piece = np.where(good, kept[at], -1)
            found_unit.append(units)
            found_at.append(at.copy())
            found_id.append(np.where(good, piece, -1 - chars[at - 1].astype(np.int64)))
            at = at - np.where(good, size[piece], 1)
        if not found_at:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        unit, place, ids = (np.concatenate(x) for x in (found_unit, found_at, found_id))
        order = np.argsort(place, kind="stable")
        unit, ids = unit[order], ids[order]
        if (ids < 0).any():  # characters without a piece: their bytes
            unit_out, ids_out = [], []
            bounds = np.flatnonzero(ids < 0)
            last = 0
            for b in bounds.tolist():
                unit_out.append(unit[last:b])
                ids_out.append(ids[last:b])
                raw = np.frombuffer(chr(-1 - int(ids[b])).encode("utf-8", "surrogatepass"), np.uint8)
                unit_out.append(np.repeat(unit[b], len(raw)))
                ids_out.append(self.byte[raw].astype(np.int64))
                last = b + 1
            unit, ids = np.concatenate([*unit_out, unit[last:]]), np.concatenate([*ids_out, ids[last:]])
        return ids.astype(np.int32), np.bincount(unit, minlength=len(lengths))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes in a row, without the blank put in front."""
        n = self.raw_length[ids]
        ends = np.cumsum(n)
        raw = self.raw[np.repeat(self.raw_start[ids] - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)]
        return raw.tobytes().decode("utf-8", "replace").removeprefix(" ")


class Encoder:
    """Ids of texts by a model; `units` bounds how many units are remembered."""

    def __init__(self, model: Model, units: int = 300_000, at_once: int = 1_000_000):
        self.model, self.limit, self.at_once = model, units, at_once
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, units: list[str]) -> None:
        """Units are indexed some `at_once` characters at a time."""
        done, size = 0, 0
        for k, unit in enumerate(units):
            size += len(unit) + 2
            if size >= self.at_once or k + 1 == len(units):
                ids, lengths = self.model.segment([BLANK + u for u in units[done: k + 1]])
                self.starts = np.concatenate([self.starts, np.cumsum(lengths) - lengths + len(self.ids)])
                self.lengths = np.concatenate([self.lengths, lengths])
                self.ids = np.concatenate([self.ids, ids])
                done, size = k + 1, 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.limit:
            self._forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        found = []
        for text in texts:
            text = text.replace(" ", BLANK)
            if not text:
                units = []
            elif text[0] != BLANK and BLANK * 2 not in text and text[-1] != BLANK:
                units = text.split(BLANK)
            else:
                units = [u[1:] for u in _UNIT.findall(BLANK + text)]
            found.append(np.fromiter(map(number, units), np.int64, len(units)))
        if len(self.numbers) > known:
            self._learn(list(self.numbers)[known:])
        out = []
        for own in found:
            n = self.lengths[own]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(self.starts[own] - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)])
        return out


def _encoder(model: Model, path: str) -> Encoder:
    cache = worker_cache("sentencepiece")
    if (path, model.kind) not in cache:
        cache[path, model.kind] = Encoder(model)
    return cache[path, model.kind]


def encode(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", kind: str = "bpe",
           check: bool = False) -> DataFrame:
    """doc_id, ids; with `check` also round_trip: whether decoding the ids gives the text back."""
    model = Model(path, kind)
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = encoder.encode([t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                mask = pa.array([t is None for t in texts])
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)]
                if check:
                    columns.append(pa.array([None if t is None else model.decode(i) == t for t, i in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.record_batch(columns, ["doc_id", "ids", "round_trip"][: len(columns)])

    kind_of_id = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind_of_id}, ids array<int>" + ", round_trip boolean" * check)


def decode(rows: DataFrame, path: str, doc: str = "doc_id", ids: str = "ids", kind: str = "bpe") -> DataFrame:
    """doc_id, text of the ids (null for a null list)."""
    model = Model(path, kind)
    rows = rows.select(F.col(doc).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else model.decode(np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
