"""Cleaning and packing of a corpus: language, quality, lines, near copies, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All stages but the last return the
columns of their documents. Null and empty texts have no language and go in the first
stage; repeated rows are near copies of one another, of which one stays; empty tables
give empty tables; columns of other names come through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.durable import shared_folder
from textguard.llm import language, lines, packing, quality, simhash


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has half or more; learned from those that are not held out."""
    names, model = language.learn(docs, ~language.held_out() & F.col("doc_id").isNotNull())
    found = language.identify(docs, names, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.cascade(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each line and its near repeats only in the first of them; n_chars follows."""
    found = lines.dedup_lines(docs)
    kinds = dict(docs.dtypes)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds.get("n_chars", "long"))}
    return found.select(*[own.get(name, F.col("row").getField(name)).alias(name) for name in docs.columns])


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return simhash.first_of_each(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", languages), ("quality", good_quality), ("lines", unique_lines),
    ("near copies", unique_documents), ("packing", sequences)]

#: Packing works on byte-pair ids, which are no SQL function; a test holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/textguard/corpus-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
