"""Languages of a document as a mixture, by expectation-maximisation over letter trigrams.

Learning counts, for every language, the hashed trigrams (letters and word borders) of
all labelled documents; tasks send one vector per language, and sums come to the driver,
bounded by languages x `BINS`. A document's trigrams are then explained by a mixture of
the languages' distributions: expectation-maximisation finds the proportions, and the
language with the least share is dropped for as long as the likelihood, penalised by half
the logarithm of the number of trigrams per language (as in BIC), does not fall. The
prediction is the language with the largest share, and its share the score.

Null texts and texts without a letter are `und` with score 0, and so is everything if
there is no labelled document. Ties go to the first language by name. Rows are looked at
one by one: repeated rows get the same result, null ids are kept but not learned from.
Only the named columns are read; an empty table gives an empty table. Texts of any length
are counted in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm.shipping import ship, worker_cache

ship(__name__)

BINS = 4096
SLICE = 500_000
ROUNDS = 8
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    cache = worker_cache("letters")
    if "table" not in cache:
        cache["table"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["table"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts (texts x BINS) of hashed trigrams whose middle is a letter; other characters are 0."""
    counts = np.zeros((len(texts), BINS), np.float32)
    letter = _letters()

    def add(rows: list[int], parts: list[str]) -> None:
        codes = _codes("".join(parts))
        codes = np.where(letter[codes], codes, 0).astype(np.uint32)
        owner = np.repeat(rows, [len(p) for p in parts])[1:-1]
        middle = codes[1:-1]
        mixed = codes[:-2] * np.uint32(0x9E3779B1) + middle * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        bins = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(20)).astype(np.int64)
        keep = middle != 0
        found = np.bincount(owner[keep] * BINS + bins[keep], minlength=0)
        at = np.flatnonzero(found)
        counts.reshape(-1)[at] += found[at]

    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        low = f"\n{text.lower()}\n"
        if size and size + len(low) > SLICE:
            add(rows, parts)
            rows, parts, size = [], [], 0
        if len(low) > SLICE:  # on its own, in slices that overlap by two characters
            for start in range(0, len(low) - 2, SLICE):
                add([row], [low[start: start + SLICE + 2]])
        else:  # next to other texts: a line feed ends each, so no letter meets another text's
            rows.append(row)
            parts.append(low)
            size += len(low)
    if parts:
        add(rows, parts)
    return counts


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of bounded rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def learn(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Names of the languages of the rows where `labelled` holds, and their trigram distributions."""
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            values = pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))
            return pa.record_batch([pa.array(list(sums), pa.string()), values], ["lang", "counts"])

        for batch in _batches(batches):
            names = np.array(batch.column(0).to_pylist(), object)
            counts = trigrams(batch.column(1).to_pylist())
            for name in set(names.tolist()):
                own = counts[names == name].sum(0, dtype=np.float64)
                sums[name] = sums.get(name, 0) + own
            if len(sums) > 500:
                yield out()
                sums.clear()
        if sums:
            yield out()

    parts = rows.mapInArrow(run, "lang string, counts array<long>")
    total = parts.select("lang", F.posexplode("counts").alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for name, place, n in total.collect():
        found.setdefault(name, np.zeros(BINS))[place] = n
    names = sorted(n for n, c in found.items() if c.any())
    smooth = np.array([found[n] + 0.5 for n in names]).reshape(-1, BINS)
    return names, smooth / smooth.sum(1, keepdims=True)


def mixtures(counts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Shares (texts x languages) of the selected languages; 0 for those that were dropped."""
    counts, model = counts.astype(np.float32), model.astype(np.float32)
    total = counts.sum(1)
    languages = len(model)

    def fit(share: np.ndarray, own: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            share = share * ((own / np.maximum(share @ model, 1e-30)) @ model.T) / n[:, None]
        return share / np.maximum(share.sum(1, keepdims=True), 1e-30)

    def likelihood(share: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (own * np.log(np.maximum(share @ model, 1e-30))).sum(1, dtype=np.float64)

    share = np.full((len(counts), languages), 1 / languages, np.float32)
    share = fit(share, counts, np.maximum(total, 1), ROUNDS)
    active = np.flatnonzero(total > 0)
    best = likelihood(share[active], counts[active])
    for _ in range(languages - 1):
        if not len(active):
            break
        now = share[active]
        size = (now > 0).sum(1)
        drop = np.where(now > 0, now, 2).argmin(1)
        fewer = now.copy()
        fewer[np.arange(len(active)), drop] = 0
        fewer /= np.maximum(fewer.sum(1, keepdims=True), 1e-30)
        own, n = counts[active], total[active]
        fewer = fit(fewer, own, n, ROUNDS // 2)
        now_best = likelihood(fewer, own)
        better = (size > 1) & (now_best + 0.5 * np.log(n) >= best)
        share[active[better]] = fewer[better]
        active, best = active[better], now_best[better]
    return share.astype(np.float64)


def identify(docs: DataFrame, names: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of `docs` in a struct `row`, and lang_pred, score, languages (name and share
    of each selected language, largest first)."""
    # The text is passed beside the row, so that columns of any name come through.
    rows = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            counts = trigrams([t or "" for t in batch.column(1).to_pylist()])
            known = (counts.sum(1) > 0) & bool(names)
            share = mixtures(counts, model) if names else np.zeros((batch.num_rows, 0))
            pred, score, found = [], [], []
            for ok, own in zip(known, share, strict=True):
                order = np.argsort(-own, kind="stable") if ok else []
                pred.append(names[order[0]] if ok else UNKNOWN)
                score.append(min(1.0, float(own[order[0]])) if ok else 0.0)
                found.append([{"lang": names[k], "share": float(own[k])} for k in order if own[k] > 0])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.record_batch([batch.column(0), pa.array(pred), pa.array(score), pa.array(found, kind)],
                                  ["row", "lang_pred", "score", "languages"])

    schema = T.StructType([*rows.select("row").schema.fields, *T.StructType.fromDDL(
        "lang_pred string, score double, languages array<struct<lang:string,share:double>>").fields])
    return rows.mapInArrow(run, schema)


def held_out(doc: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether the row's id falls into the fold that is not learned from."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % folds == fold, F.lit(False))


def languages(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learned from the rows that are not held out."""
    names, model = learn(docs, ~held_out(doc) & F.col(doc).isNotNull(), text, lang)
    found = identify(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), names, model)
    return found.select("row.doc_id", "lang_pred", "score", "languages").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
