"""Byte-pair ids of whole texts for the word-level public tokenizer, word by word.

Text between blanks and line feeds is encoded once per worker and looked up from then
on; the ids are those of the `tokenizers` library, which also encodes whatever is not
made of ASCII and Latin-1 letters, digits and punctuation. The merges of many different
words run side by side in numpy: words of one length lose one symbol per round.
"""

from __future__ import annotations

import json
import re

import numpy as np

from textguard.llm.shipping import ship, worker_cache

ship(__name__)

#: Pre-tokens of the vocabulary `word_bpe_49k`, for the characters of `_PLAIN`. Fixed values.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Words that composition and lower-casing treat alike everywhere.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-/:-@\[-`{-~]*")
_LONGEST = 64
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable,
    else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class _Words(dict):
    """Number of each word; a word that is asked for the first time gets the next one."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class WordBpe:
    """Ids of texts. `words` bounds the number of words that are remembered."""

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, symbols = model["vocab"], byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int32)
        self.last = np.array([vocabulary[s + "</w>"] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * 65536 + vocabulary[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        self.library = Tokenizer.from_file(path)
        self.limit = words
        self._forget()

    def _forget(self) -> None:
        self.words = _Words({"": 0})
        self.lengths = np.zeros(1, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        if len(self.words) > self.limit:
            self._forget()
        known = len(self.words)
        number = self.words.__getitem__
        found = [np.fromiter(map(number, t.replace("\n", " ").split(" ")), np.int64) for t in texts]
        if len(self.words) > known:
            self._learn(list(self.words)[known:])
        sizes = np.array([self.lengths[f].sum() for f in found], np.int64)
        every = np.concatenate(found) if found else np.zeros(0, np.int64)
        return self._gather(self.starts[every], self.lengths[every]), sizes

    def _gather(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        lengths_sum = np.cumsum(lengths)
        total = int(lengths_sum[-1]) if len(lengths) else 0
        return self.ids[np.repeat(starts - lengths_sum + lengths, lengths) + np.arange(total)]

    def _learn(self, words: list[str]) -> None:
        pieces, piece_of, count, strange = _Words(), [], np.zeros(len(words), np.int64), []
        for k, word in enumerate(words):
            if _PLAIN.fullmatch(word) and "<|" not in word:
                low = word.lower()
                if low.isalpha():
                    cut = [low]
                else:
                    cut = _PIECES.findall(low)
                if max(map(len, cut)) * 2 <= _LONGEST:
                    piece_of.extend(map(pieces.__getitem__, cut))
                    count[k] = len(cut)
                    continue
            strange.append(k)
        ids, lengths = self._merge(list(pieces))
        starts = np.cumsum(lengths) - lengths
        piece_of = np.array(piece_of, np.int64)
        # a word's ids: those of its pieces, which are put one after the other
        n = lengths[piece_of]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[piece_of] - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
        word_starts, word_lengths = upto[:-1].copy(), np.diff(upto)
        late = [one.ids for one in self.library.encode_batch([words[k] for k in strange], add_special_tokens=False)]
        late_lengths = np.array([len(ids) for ids in late], np.int64)
        word_starts[strange] = len(flat) + np.cumsum(late_lengths) - late_lengths
        word_lengths[strange] = late_lengths
        flat = np.concatenate([flat, np.array([x for ids in late for x in ids], np.int32)])
        self.starts = np.concatenate([self.starts, word_starts + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, word_lengths])
        self.ids = np.concatenate([self.ids, flat])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * 65536 + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many belong to each."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        lengths = np.zeros(len(raw), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[by_size], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(raw)], strict=True):
            rows = by_size[lo:hi]
            n = int(size[rows[0]])
            data = np.frombuffer(b"".join([raw[k] for k in rows]), np.uint8).reshape(-1, n).T
            token = self.inner[data]
            token[-1] = self.last[data[-1]]
            rank = self._ranks(token[:-1], token[1:])
            while True:
                if n == 1:
                    done.append((rows, token))
                    break
                place = rank.argmin(0)
                here = np.arange(len(rows))
                best = rank[place, here]
                stop = best == _NONE
                if stop.any():
                    done.append((rows[stop], token[:, stop]))
                    go = ~stop
                    rows, token, rank, place, best = rows[go], token[:, go], rank[:, go], place[go], best[go]
                    here = here[: len(rows)]
                    if not len(rows):
                        break
                token[place, here] = self.merged[best]
                n -= 1
                for c in range(1, n):  # close the gap behind the merged symbol
                    np.copyto(token[c], token[c + 1], where=place < c)
                token = token[:n]
                for c in range(n - 1):
                    np.copyto(rank[c], rank[c + 1], where=place <= c)
                rank = rank[: n - 1]
                some = np.flatnonzero(place > 0)
                rank[place[some] - 1, some] = self._ranks(token[place[some] - 1, some], token[place[some], some])
                some = np.flatnonzero(place < n - 1)
                rank[place[some], some] = self._ranks(token[place[some], some], token[place[some] + 1, some])
        for rows, token in done:
            lengths[rows] = len(token)
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        for rows, token in done:
            for c, ids in enumerate(token):
                flat[starts[rows] + c] = ids
        return flat, lengths


def tokenizer(path: str) -> WordBpe:
    """This worker's encoder for a vocabulary file."""
    cache = worker_cache("word_bpe")
    if path not in cache:
        cache[path] = WordBpe(path)
    return cache[path]
