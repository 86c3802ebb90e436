"""Most similar documents per query vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textguard import rules
from textguard.operators.cells import similar_by_cells

MAX_QUERIES = 2048
_ROWS_AT_ONCE = 1024
_DIGITS = 9


def _best(query_ids: list, queries: np.ndarray, k: int, min_similarity: float, schema: pa.Schema, digits: int,
          rows_at_once: int):
    """A `mapInArrow` function from (id, vector) rows to the task's best `k`
    documents per query.

    Similarities come from matrix products over slices of rows; only scores
    that beat what a query already has are looked at one by one."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [np.array([], dtype=object) for _ in query_ids]
        scores = [np.array([]) for _ in query_ids]
        floor = np.full(len(query_ids), min_similarity)
        for batch in batches:
            present = batch.filter(batch.column(1).is_valid())
            for start in range(0, len(present), rows_at_once):
                part = present.slice(start, rows_at_once)
                vectors = part.column(1)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(sizes == queries.shape[1]))
                if not len(part):
                    continue
                docs = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                docs = docs.reshape(len(part), queries.shape[1])
                norms = np.linalg.norm(docs, axis=1)
                docs = docs / np.where(norms > 0, norms, 1.0)[:, None]
                found = np.round(queries @ docs.T, digits)
                doc_ids = np.array(part.column(0).to_pylist(), dtype=object)
                for q in np.nonzero(found.max(axis=1) >= floor)[0]:
                    hits = np.nonzero(found[q] >= floor[q])[0]
                    some = np.concatenate([scores[q], found[q][hits]])
                    names = np.concatenate([ids[q], doc_ids[hits]])
                    order = sorted(range(len(some)), key=lambda i: (-some[i], names[i]))[:k]
                    scores[q], ids[q] = some[order], names[order]
                    if len(order) == k:
                        floor[q] = scores[q][-1]
        for q, name in enumerate(query_ids):
            if len(scores[q]):
                n = len(scores[q])
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * n, schema.types[0]), pa.array(list(ids[q]), schema.types[1]),
                    pa.array(scores[q], pa.float64())], schema=schema)

    return scan


def similar_documents(queries: DataFrame, documents: DataFrame, query_id: str = "query_id",
                      doc_id: str = "doc_id", embedding: str = "embedding", k: int = rules.MAX_CHUNKS,
                      min_similarity: float = rules.SIMILARITY_THRESHOLD,
                      max_queries: int = MAX_QUERIES) -> DataFrame:
    """The `k` documents most similar (cosine) to each query, at least
    `min_similarity`: `query_id, doc_id, similarity, rank`.

    Exact: up to `max_queries` queries, which are counted first, travel with the task,
    and every document is compared within its scan by matrix products; documents are
    not shuffled, and each task passes on `k` rows per query. More queries are joined
    with the documents over cells of directions (`cells.similar_by_cells`). Similarities
    are compared to nine digits, equal ones ranked by id.
    """
    if queries.count() > max_queries:
        return similar_by_cells(queries, documents, query_id, doc_id, embedding, k, min_similarity)
    columns = [
        queries.schema[query_id].jsonValue() | {"name": query_id},
        documents.schema[doc_id].jsonValue() | {"name": doc_id},
    ]
    schema = type(queries.schema).fromJson({"type": "struct", "fields": columns}).add("similarity", "double")
    best = None
    by_dim: dict[int, list] = {}
    for row in queries.select(query_id, embedding).collect():
        if row[embedding]:
            by_dim.setdefault(len(row[embedding]), []).append(row)
    for same in by_dim.values():
        matrix = np.array([r[embedding] for r in same], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1)
        matrix = matrix / np.where(norms > 0, norms, 1.0)[:, None]
        found = documents.select(doc_id, embedding).mapInArrow(
            _best([r[query_id] for r in same], matrix, k, min_similarity, to_arrow_schema(schema),
                  _DIGITS, _ROWS_AT_ONCE), schema)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return queries.sparkSession.createDataFrame([], schema.add("rank", "integer"))
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.col(doc_id))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
