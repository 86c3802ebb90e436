"""Exact top-k similarity of many queries with many documents, as joins over cells of vectors.

Directions are divided into cells around centres (a spherical k-means on a bounded sample;
the centres decide only how much is compared, never the result). A cell's radius is the
largest angle between its centre and a document in it. By the triangle inequality on the
sphere no document of a cell is nearer to a query than the angle to the centre less the
radius, so a query meets only cells that this bound leaves above the least similarity and
above its k-th best so far: it meets its nearest cell first, then, with what that gave, the
others. Cells come in parts of bounded size, queries in groups of neighbours, and one task
multiplies one part with one group. Documents are read twice from the source (a sample,
then all of them), however many queries there are; queries never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.durable import durable

#: Centres per length of vectors, and the vectors they are fitted on.
CELLS, SAMPLE = 256, 8192
#: Documents in a part of a cell and queries in a group.
ROWS = 8192
#: Vectors in one matrix product.
_AT_ONCE = 1024
#: The last number of a cell is that of vectors without a direction.
_NUMBERS = 1024
#: What rounding may add to a bound.
_SLACK = 1e-6
DIGITS = 9


def _shipped():
    """The functions that run in tasks, as closures, so that they travel by value."""
    numbers, slack, at_once, digits = _NUMBERS, _SLACK, _AT_ONCE, DIGITS

    def by_length(vectors: pa.ListArray):
        """Rows and unit vectors (zeros for zero vectors) per length; rows that are null, empty or not finite are left out."""
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            flat = vectors.take(pa.array(rows)).flatten()
            matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.linalg.norm(matrix, axis=1)
                good = np.isfinite(norms)
                matrix = matrix[good] / np.where(norms > 0, norms, 1.0)[good, None]
            yield int(size), rows[good], matrix, norms[good] == 0

    def listed(matrix: np.ndarray) -> pa.ListArray:
        n, width = matrix.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))

    def assigner(centres: dict[int, np.ndarray]):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, rows, units, zero in by_length(batch.column(1)):
                    if size in centres:
                        cosines = units @ centres[size].T
                        nearest = cosines.argmax(1)
                        angle = np.arccos(np.clip(cosines[np.arange(len(rows)), nearest], -1, 1))
                    else:  # no centre: one cell of all directions
                        nearest, angle = np.zeros(len(rows), np.int64), np.full(len(rows), np.pi)
                    cell = size * numbers + np.where(zero, numbers - 1, nearest)
                    yield pa.record_batch([
                        batch.column(0).take(pa.array(rows)), pa.array(cell, pa.int64()), pa.array(np.where(zero, 0.0, angle)),
                        listed(units)],
                        ["id", "cell", "angle", "unit"])
        return assign

    def near(centres: dict[int, np.ndarray], size: int, units: np.ndarray, cells: list[int]) -> np.ndarray:
        """Angles between vectors and the centres of some cells with a direction."""
        if size not in centres:
            return np.full((len(units), len(cells)), np.pi)
        return np.arccos(np.clip(units @ centres[size][[c % numbers for c in cells]].T, -1, 1))

    def router(centres: dict[int, np.ndarray], cells: dict[int, list[tuple[int, float, int]]], homes: dict[int, tuple[int, int]] | None, home_only: bool):
        """Rows (id, unit, floor) with their group and the blocks they must meet: that of the nearest centre, or all
        others the bound leaves. Without groups (`homes`), the nearest cell alone, to count them."""
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                floors = batch.column(2).to_numpy(zero_copy_only=False)
                for size, rows, units, zero in by_length(batch.column(1)):
                    known = [x for x in cells.get(size, ()) if x[0] % numbers != numbers - 1]
                    blank = [x for x in cells.get(size, ()) if x[0] % numbers == numbers - 1]
                    if not known and not blank:
                        continue
                    most = np.zeros((len(rows), len(known) + len(blank)))  # the zero vector is at similarity 0 from all
                    angle = np.full(most.shape, 4.0)
                    if known:
                        angle[:, :len(known)] = near(centres, size, units, [c for c, _, _ in known])
                        most[:, :len(known)] = np.cos(np.maximum(angle[:, :len(known)] - np.array([r for _, r, _ in known]), 0))
                        most[zero] = 0.0
                    home = angle.argmin(1)
                    named = np.array([c for c, _, _ in known + blank], np.int64)[home]
                    if homes is None:
                        yield pa.record_batch([pa.array(named)], ["home"])
                        continue
                    block = np.array([b for _, _, b in known + blank], np.int64)
                    meets = most >= floors[rows][:, None] - slack
                    names, at = np.unique(block, return_inverse=True)
                    wanted = np.zeros((len(rows), len(names)), bool)
                    for cell, place in enumerate(at):
                        wanted[:, place] |= meets[:, cell]
                    own = np.zeros_like(wanted)
                    own[np.arange(len(rows)), at[home]] = True
                    wanted &= own if home_only else ~own
                    r, c = np.nonzero(wanted)
                    offsets = np.concatenate([[0], np.cumsum(wanted.sum(1))])
                    group, parts = (np.array([homes.get(h, (0, 1))[i] for h in named.tolist()], np.int64) for i in (0, 1))
                    some = np.flatnonzero(wanted.any(1))
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names[c]))
                    yield pa.record_batch([
                        batch.column(0).take(pa.array(rows[some])), listed(units[some]), batch.column(2).take(pa.array(rows[some])),
                        pa.array(group[some]), pa.array(parts[some]), lists.take(pa.array(some))],
                        ["id", "unit", "floor", "group", "groups", "blocks"])
        return route

    def matcher(k: int, names: list[str], types: list[pa.DataType]):
        """Per query of a group the best `k` documents of a part, from matrix products of bounded size."""
        def matrix(column: pa.ChunkedArray) -> np.ndarray:
            whole = column.combine_chunks()
            return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)

        def match(queries: pa.Table, docs: pa.Table) -> pa.Table:
            found = [[], [], []]
            if len(queries) and len(docs):
                # In the order of ids, equal similarities come out in it as well.
                docs = docs.take(pc.sort_indices(docs["id"].combine_chunks(), null_placement="at_start"))
                units, vectors, floors = matrix(queries["unit"]), matrix(docs["unit"]), queries["floor"].to_numpy()
                for a in range(0, len(units), at_once):
                    floor = floors[a: a + at_once, None]
                    rows, cols, values = (np.zeros(0, t) for t in (np.int64, np.int64, float))
                    for b in range(0, len(vectors), at_once * 8):
                        cosines = np.round(units[a: a + at_once] @ vectors[b: b + at_once * 8].T, digits)
                        if cosines.shape[1] > k:
                            floor = np.maximum(floor, np.partition(cosines, -k, axis=1)[:, -k, None])
                        r, c = np.nonzero(cosines >= floor)
                        rows, cols, values = np.concatenate([rows, r]), np.concatenate([cols, c + b]), np.concatenate([values, cosines[r, c]])
                        order = np.lexsort((cols, -values, rows))
                        rows, cols, values = rows[order], cols[order], values[order]
                        first = np.searchsorted(rows, rows)
                        best = np.arange(len(rows)) - first < k
                        rows, cols, values = rows[best], cols[best], values[best]
                    found = [x + [y] for x, y in zip(found, (rows + a, cols, values), strict=True)]
            rows, cols, values = (np.concatenate(x) if x else np.zeros(0) for x in found)
            return pa.table([
                queries["id"].combine_chunks().take(pa.array(rows, pa.int64())).cast(types[0]), docs["id"].combine_chunks().take(pa.array(cols, pa.int64())).cast(types[1]),
                pa.array(values, pa.float64())], names=names)
        return match

    return assigner, router, matcher


def _packed(counts: dict[int, int], centres: dict[int, np.ndarray], rows: int) -> dict[int, tuple[int, int]]:
    """Each cell with its block and the number of parts it comes in: neighbouring small cells share a block
    of up to `rows` rows, a larger one is a block of its own, in parts."""
    out, number = {}, 0
    for size in sorted({c // _NUMBERS for c in counts}):
        left, held, last = sorted(c for c in counts if c // _NUMBERS == size), 0, None
        number += 1
        while left:
            cell = left[0]
            if last is not None and size in centres:
                own = {c: float(centres[size][c % _NUMBERS] @ centres[size][last % _NUMBERS])
                       for c in left if c % _NUMBERS < len(centres[size])}
                cell = max(own, key=own.get) if own else cell
            left.remove(cell)
            if held and held + counts[cell] > rows:
                number, held = number + 1, 0
            out[cell] = (number, max(1, -(-counts[cell] // rows)))
            held += counts[cell]
            last = cell if size in centres and cell % _NUMBERS < len(centres[size]) else last
    return out


def fit_centres(documents: DataFrame, embedding: str, cells: int, sample: int, seed: int = 11) -> dict[int, np.ndarray]:
    """Unit centres per length of vectors, from about `sample` vectors (at most twice as many)."""
    total = documents.count()
    some = documents.select(F.col(embedding).cast("array<double>").alias("v")).where("v is not null")
    rows = (some if total <= sample else some.sample(fraction=sample / total, seed=seed)).limit(2 * sample).toPandas()["v"]
    by_size: dict[int, list] = {}
    for vector in rows:
        values = np.array(vector, float)
        if len(values) and np.isfinite(values).all() and values.any():
            by_size.setdefault(len(values), []).append(values / np.linalg.norm(values))
    rng, out = np.random.default_rng(seed), {}
    for size, vectors in by_size.items():
        points = np.array(vectors)
        own = points[rng.choice(len(points), min(cells, max(1, int(np.sqrt(total) / 2)), len(points)), replace=False)]
        for _ in range(5):
            nearest = (points @ own.T).argmax(1)
            sums = np.zeros_like(own)
            np.add.at(sums, nearest, points)
            lengths = np.linalg.norm(sums, axis=1)
            own = np.where((lengths > 0)[:, None], sums / np.where(lengths > 0, lengths, 1)[:, None], own)
        out[size] = own
    return out


def similar_by_cells(queries: DataFrame, documents: DataFrame, query_id: str, doc_id: str, embedding: str, k: int,
                     min_similarity: float, cells: int = CELLS, sample: int = SAMPLE, rows: int = ROWS) -> DataFrame:
    """`query_id, doc_id, similarity, rank`: per query the `k` most similar documents of the same length.

    Repeated query ids share their best `k`. Vectors that are null, empty or not finite are
    similar to none; zero vectors have similarity 0 with all."""
    if cells >= _NUMBERS:
        raise ValueError(f"fewer than {_NUMBERS} cells")
    spark = documents.sparkSession
    assigner, router, matcher = _shipped()
    centres = fit_centres(documents, embedding, cells, sample)
    id_types = [queries.schema[query_id].dataType.simpleString(), documents.schema[doc_id].dataType.simpleString()]
    placed = documents.select(F.col(doc_id).alias("id"), F.col(embedding).cast("array<double>").alias("unit")).mapInArrow(
        assigner(centres), f"id {id_types[1]}, cell long, angle double, unit array<double>")
    placed = durable(placed)
    # A row per cell: at most `cells` and one for each length that occurs.
    stats = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    blocks = _packed({row.cell: row.n for row in stats}, centres, rows)
    known: dict[int, list[tuple[int, float, int]]] = {}
    for row in stats:
        known.setdefault(row.cell // _NUMBERS, []).append((row.cell, row.radius, blocks[row.cell][0]))
    # A large cell is alone in its block, so that a block has one number of parts.
    laid = durable(spark.createDataFrame([(c, b, p) for c, (b, p) in blocks.items()], "cell long, block long, parts int"))
    own = placed.join(F.broadcast(laid), "cell").select("id", "unit", "block", F.pmod(F.xxhash64("id", "unit"), F.col("parts")).cast("int").alias("part"))
    parts = durable(laid.select("block", "parts").distinct())
    asked = queries.select(F.col(query_id).alias("id"), F.col(embedding).cast("array<double>").alias("unit"))
    start = asked.withColumn("floor", F.lit(float(min_similarity)))
    homes = _packed({row.home: row["count"] for row in start.mapInArrow(
        router(centres, known, None, True), "home long").groupBy("home").count().collect()}, centres, rows)
    routed_type = f"id {id_types[0]}, unit array<double>, floor double, group long, groups long, blocks array<long>"

    names = ["query", "doc", "similarity"]
    found_type = f"query {id_types[0]}, doc {id_types[1]}, similarity double"
    arrow = spark.createDataFrame([], found_type).toArrow().schema.types

    def matched(rows_with_floor: DataFrame, home_only: bool) -> DataFrame:
        """The best of the blocks each query meets; its row is written once, with their list, and sent to each part."""
        routed = durable(rows_with_floor.mapInArrow(router(centres, known, homes, home_only), routed_type))
        meeting = routed.withColumn("slot", F.pmod(F.xxhash64("id", "unit"), F.col("groups")).cast("int")).withColumn(
            "block", F.explode("blocks")).join(F.broadcast(parts), "block").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "unit", "floor", "block", "part", "group", "slot")
        key = ["block", "part", "group", "slot"]
        wanted = meeting.select(*[F.col(c).alias(c) for c in key]).distinct()
        theirs = own.join(wanted, ["block", "part"]).select("id", "unit", *[F.col(c).alias(c) for c in key])
        return meeting.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(matcher(k, names, arrow[:2]), found_type)

    best = Window.partitionBy("query").orderBy(F.desc("similarity"), F.col("doc"))
    first = durable(matched(start, True))
    # What a query has after its own block bounds what the others must offer.
    reached = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).where(F.col("rank") == k).select(
        F.col("query"), F.col("similarity").alias("reached"))
    raised = asked.join(reached, F.col("id").eqNullSafe(F.col("query")), "left").select(
        "id", "unit", F.greatest(F.lit(float(min_similarity)), F.coalesce("reached", F.lit(float(min_similarity)))).alias("floor"))
    rest = matched(raised, False)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col("query").alias(query_id), F.col("doc").alias(doc_id), "similarity", "rank")
