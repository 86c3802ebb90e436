"""Log-probabilities of documents by word counts and by a gated recurrent model.

Learning takes four passes over the documents to learn from: word counts of them all
(tasks send their own sums); the model's first weights, by truncated backpropagation over
one document in `WARM` of them; its weights, by every task over all of its documents from
those, then averaged by the number of tokens; and the scores. Counts grow with the corpus
and stay in a table. To the driver come only the `FREQUENT` most frequent words of at most
64 bytes (at most 200,000, for lookups in the tasks) and the model's weights.

The model's tokens are the most frequent words, the document's end, and one for all other
words, whose probability it shares among them by their counts plus one; so it is a
distribution over all texts. A text's score carries the state through its whole length.

Per text: words are what lies between ASCII white space, A-Z in lower case; one end
follows. Null and empty texts are the end alone. Without documents to learn from all
counts are 0. Rows are scored one by one, so repeated rows and null ids come out as often
as they go in. Only the named columns are read; an empty table gives an empty table.
Words that are not among the frequent ones are joined with the table of counts, a row per
word and document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.durable import durable
from textguard.llm.gru import Gru, Trainer, log_likelihoods
from textguard.llm.shipping import ship

ship(__name__)

FREQUENT = 200_000
LONGEST = 64
CLASSES, SIZE, HIDDEN = 16, 32, 16
WARM = 16
CHUNK = 1024
_ROWS = 512


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII only, both


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), c: how often each word occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for part in _texts(batches):
            for value in part.column(0).to_pylist():
                counts.update(words(value))
            if len(counts) > 1_000_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Corpus:
    """What the tasks look words up in: numbers and counts of the frequent words (the first
    `named` of them are tokens of the model), and totals."""

    number: dict[bytes, int]
    counts: np.ndarray
    documents: int
    tokens: int
    distinct: int
    named: int
    other_tokens: int
    other_distinct: int

    @property
    def end(self) -> int:
        return self.named

    @property
    def other(self) -> int:
        return self.named + 1


def corpus(counts: DataFrame, documents: int, frequent: int = FREQUENT, named: int = CLASSES * SIZE - 2) -> tuple[Corpus, DataFrame]:
    """The corpus's totals and frequent words, and the counts of the other words."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = F.octet_length("word") <= LONGEST
    # the least count whose words, with all more frequent ones, number at most `frequent`
    levels = counts.where(short).groupBy("c").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = levels.orderBy(F.desc("c")).limit(frequent).withColumn("upto", upto).where(F.col("upto") <= frequent).agg(F.min("c")).first()[0]
    often = short & (F.col("c") >= (least if least is not None else 2**62))
    top = sorted(((c, bytes(w)) for w, c in counts.where(often).collect()), key=lambda row: (-row[0], row[1]))
    named = min(named, len(top))
    own = sum(c for c, _ in top[:named])
    return Corpus(
        {word: k for k, (_, word) in enumerate(top)}, np.array([c for c, _ in top], np.int64), documents,
        total + documents, distinct + (documents > 0), named, total - own, distinct - named), counts.where(~often)


def first_model(known: Corpus) -> Gru:
    frequencies = np.zeros(CLASSES * SIZE)
    frequencies[: known.named] = known.counts[: known.named]
    frequencies[known.end], frequencies[known.other] = known.documents, known.other_tokens
    return Gru(frequencies, CLASSES, HIDDEN, known.end)


def _numbers(texts: list, known: Corpus) -> tuple[np.ndarray, np.ndarray, list]:
    """Numbers of the words (-1: not frequent) of all texts, how many each has, and the words."""
    lists = [words(t) for t in texts]
    get = known.number.get
    flat = np.array([get(w, -1) for ws in lists for w in ws], np.int64)
    return flat, np.array([len(ws) for ws in lists], np.int64), lists


def _tokens(flat: np.ndarray, sizes: np.ndarray, known: Corpus) -> np.ndarray:
    """The model's tokens of all texts, each with its end."""
    own = np.where((flat >= 0) & (flat < known.named), flat, known.other)
    return np.insert(own, np.cumsum(sizes), known.end)


def train(docs: DataFrame, shared, weights: np.ndarray, text: str = "text") -> np.ndarray:
    """Weights after each task has learned from its texts, starting from `weights`: their mean by
    tokens. Weights travel in chunks; chunks of one place are averaged in two steps, so that no
    task gets those of more than a part of all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Corpus(**shared.value)
        trainer = Trainer(first_model(known).load(weights))
        for part in _texts(batches):
            flat, sizes, _ = _numbers(part.column(0).to_pylist(), known)
            trainer.learn(_tokens(flat, sizes, known))
        trainer.learn(np.zeros(0, np.int64), last=True)
        if trainer.tokens:
            learned = trainer.model.weights()
            parts = [learned[k: k + CHUNK].astype(np.float64) for k in range(0, len(learned), CHUNK)]
            n = len(parts)
            yield pa.record_batch([
                pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, TaskContext.get().partitionId() % 64), pa.int32()),
                pa.array(parts, pa.list_(pa.float64())), pa.array(np.full(n, float(trainer.tokens)))],
                ["chunk", "part", "weights", "tokens"])

    def mean(table: pa.Table) -> pa.Table:
        tokens = table["tokens"].to_numpy()
        rows = np.array(table["weights"].to_pylist())
        return pa.table({"chunk": table["chunk"][:1], "part": table["part"][:1], "weights": pa.array([tokens @ rows / tokens.sum()], pa.list_(pa.float64())),
                         "tokens": pa.array([tokens.sum()])})

    schema = "chunk int, part int, weights array<double>, tokens double"
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    rows = rows.groupBy("chunk", "part").applyInArrow(mean, schema).groupBy("chunk").applyInArrow(mean, schema)
    found = sorted((r.chunk, r.weights) for r in rows.select("chunk", "weights").collect())
    return np.concatenate([w for _, w in found]).astype(np.float32) if found else weights


_SCORED = "row long, doc_id {}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, times long"


def _score(docs: DataFrame, shared, weights: np.ndarray, kind: str, group_tokens: int = 3_000_000) -> DataFrame:
    """One row per document with what the frequent words give, and one per document and other word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Corpus(**shared.value)
        model = first_model(known).load(weights)
        row = TaskContext.get().partitionId() << 40
        base_of = np.log10((known.counts + 1) / (known.tokens + known.distinct + 1))
        end_base = np.log10(((known.documents) + 1) / (known.tokens + known.distinct + 1))
        inside = np.log10((known.counts + 1) / (known.other_tokens + known.other_distinct + 1))
        inside[: known.named] = 0
        waiting: list[tuple] = []

        def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            return np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=values, minlength=len(sizes))

        def scored() -> pa.RecordBatch:
            ids = pa.concat_arrays([w[0] for w in waiting])
            held = pa.concat_arrays([w[1] for w in waiting])
            rows, n, n_known, base, share = (np.concatenate([w[k] for w in waiting]) for k in range(2, 7))
            lengths = np.concatenate([w[8] for w in waiting])
            lm = log_likelihoods(model, np.concatenate([w[7] for w in waiting]), lengths) / np.log(10)
            waiting.clear()
            none = len(rows)
            return pa.record_batch([
                pa.array(rows), ids, held, pa.array(n), pa.array(n_known), pa.array(base), pa.array(lm + share),
                pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64())], NAMES)

        size = 0
        for part in _texts(batches):
            texts = part.column(2).to_pylist()
            flat, sizes, lists = _numbers(texts, known)
            seen = flat >= 0
            at = np.where(seen, flat, 0)
            found = bool(len(known.counts))
            base = sums(np.where(seen, base_of[at], 0) if found else np.zeros(len(flat)), sizes) + end_base
            share = sums(np.where(seen, inside[at], 0) if found else np.zeros(len(flat)), sizes)
            n_known = sums(seen, sizes).astype(np.int64) + (known.documents > 0)
            rows = np.arange(row, row + len(texts), dtype=np.int64)
            row += len(texts)
            waiting.append((part.column(0), part.column(1), rows, sizes + 1, n_known, base, share, _tokens(flat, sizes, known), sizes + 1))
            size += len(flat) + len(texts)
            rare_row, rare_word, rare_times = [], [], []
            ends = np.cumsum(sizes)
            for k, own in enumerate(lists):
                if own:
                    rest = Counter(own[i] for i in np.flatnonzero(~seen[ends[k] - len(own): ends[k]]).tolist())
                    rare_row += [rows[k]] * len(rest)
                    rare_word += rest.keys()
                    rare_times += rest.values()
            n = len(rare_row)
            yield pa.record_batch([
                pa.array(rare_row, pa.int64()), pa.nulls(n, part.column(0).type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(rare_word, pa.binary()),
                pa.array(rare_times, pa.int64())], NAMES)
            if size >= group_tokens:
                yield scored()
                size = 0
        if waiting:
            yield scored()

    return docs.mapInArrow(run, _SCORED.format(kind))


NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]


def held_out(doc: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether the row's id falls into the fold that is not learned from."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % folds == fold, F.lit(False))


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known (tokens that were learned), train_tokens, base_score (log10
    probability by smoothed counts), score (log10 probability by the model)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).alias("doc_id"), held_out(doc).alias("held_out"), F.col(text).cast("string").alias("text"))
    learned = docs.where(~held_out(doc)).select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = durable(word_counts(learned))
    known, others = corpus(counts, learned.count(), frequent)
    shared = spark.sparkContext.broadcast(vars(known))  # plain values: executors need not import the class
    weights = first_model(known).weights()
    warm = learned.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(WARM)) == 0)
    for texts in (warm, learned):
        weights = train(texts, shared, weights)
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = durable(_score(rows, shared, weights, kind))
    c = F.coalesce("c", F.lit(0))
    rare = parts.where("word is not null").select("row", "word", "times").join(others, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(known.tokens + known.distinct + 1))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(known.other_tokens + known.other_distinct + 1))).alias("rare_score"))
    whole = parts.where("word is null").join(rare, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
