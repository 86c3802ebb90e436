"""Conversation drift over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard import rules
from textguard.durable import durable
from textguard.functions import vectors as vec
from textguard.functions.text import is_trivial_turn
from textguard.operators.ordered import ROWS_PER_TASK, SEGMENT, Ordered, join_null_safe, large_keys, with_segments
from textguard.operators.ratelimit import cooldown

#: Vectors of a key that one task follows; beyond, the key is cut.
BYTES_PER_TASK = 2 * 2**30


_VALUES = ("similarity", "drift", "change_rate", "max_drift", "max_change_rate")


def _follower():
    """A `mapInArrow` function over (key parts, ..., vector) rows sorted by key and order, as a closure.

    It holds one Arrow batch and, over its border, a key's first and previous vector, the
    previous similarity and the running maxima. Columns `_first`, `_last`, `_similarity`,
    `_turns`, `_drift`, `_change`, where given, are what earlier rows of the key left."""
    def follow(keys: list[str], given: bool):
        def starts_of(batch: pa.RecordBatch) -> np.ndarray:
            n = batch.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for name in keys:
                column = batch.column(name)
                one, other = column.slice(1), column.slice(0, n - 1)
                same = pc.if_else(pc.and_(one.is_null(), other.is_null()), True, pc.fill_null(pc.equal(one, other), False))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            return np.flatnonzero(new)

        def cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
            lengths = na * nb
            return np.where(lengths > 0, np.einsum("ij,ij->i", a, b) / np.where(lengths > 0, lengths, 1), 0.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_key, state = None, None
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                vectors = batch.column("_vector")
                width = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
                if len(width) > 1:
                    raise ValueError(f"vectors of different lengths: {width.tolist()}")
                matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, int(width[0]))
                norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
                starts = starts_of(batch)
                out = {name: np.zeros(n) for name in ("similarity", "drift", "change_rate", "max_drift", "max_change_rate")}
                for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                    key = tuple(batch.column(k)[lo].as_py() for k in keys)
                    if key != last_key:
                        last_key, state = key, None
                        if given and batch.column("_turns")[lo].as_py():
                            first, last = (np.array(batch.column(c)[lo].as_py(), float) for c in ("_first", "_last"))
                            state = (first, last, *(batch.column(c)[lo].as_py() for c in ("_similarity", "_turns", "_drift", "_change")))
                    own, length = matrix[lo:hi], norms[lo:hi]
                    turns = 0 if state is None else state[3]
                    first = own[0] if state is None else state[0]
                    before = np.vstack([own[:1] if state is None else state[1][None], own[:-1]])
                    before_norm = np.sqrt(np.einsum("ij,ij->i", before, before))
                    similarity = cosines(own, before, length, before_norm)
                    drift = 1.0 - cosines(own, np.broadcast_to(first, own.shape), length, np.full(hi - lo, np.sqrt(first @ first)))
                    if state is None:
                        similarity[0] = drift[0] = 0.0
                    change = np.abs(np.diff(similarity, prepend=0.0 if state is None else state[2]))
                    change[: max(0, 2 - turns)] = 0.0
                    most, most_change = (np.maximum.accumulate(x) if state is None else np.maximum(np.maximum.accumulate(x), state[k])
                                         for x, k in ((drift, 4), (change, 5)))
                    for name, values in zip(out, (similarity, drift, change, most, most_change)):
                        out[name][lo:hi] = values
                    state = (first.copy(), own[-1].copy(), float(similarity[-1]), turns + hi - lo, float(most[-1]), float(most_change[-1]))
                kept = [name for name in batch.schema.names if name not in ("_vector", "_first", "_last", "_similarity", "_turns", "_drift", "_change")]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(name) for name in kept], *[pa.array(v) for v in out.values()]], names=[*kept, *out])
        return run
    return follow


def drift_values(df: DataFrame, key: str, ts: str, row_id: str, embedding: str = "embedding",
                 bytes_per_task: int = BYTES_PER_TASK, rows_per_task: int | None = None) -> DataFrame:
    """`key, ts, row_id, similarity, drift, change_rate, max_drift, max_change_rate` per turn.

    One exchange of these columns and one vector a turn; then a kernel follows each key's
    sorted rows over Arrow batches. A key with more than `bytes_per_task` of vectors is cut
    into segments that are followed side by side, each from what the one before it leaves:
    its last two vectors are enough for similarity and change, the key's first for drift,
    and maxima are joined up over the segments' own. Turns without a vector are left out; the
    vectors of a key must have one length."""
    vector = F.col(embedding) if dict(df.dtypes)[embedding] == "array<float>" else vec.doubles(F.col(embedding))
    order = list(dict.fromkeys([ts, row_id]))  # the two may be one column
    named = [key, *order]
    narrow = df.select(*named, vector.alias("_vector")).where(F.size("_vector") > 0)
    kinds = dict(narrow.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in named], *[f"{name} double" for name in _VALUES]])
    if rows_per_task is None:
        width = F.size("_vector") * 8 + 32
        large = durable(narrow.groupBy(key).agg(F.sum(width).alias("_bytes"), F.avg(width).alias("_each")).where(F.col("_bytes") > bytes_per_task))
        each = large.agg(F.max("_each")).first()[0]
        large, rows_per_task = (None, 0) if each is None else (large.select(key), max(1, int(bytes_per_task / each)))
    else:
        large = large_keys(narrow.select(key), [key], rows_per_task)
    follow = _follower()
    if large is None:
        rows = narrow.repartition(key).sortWithinPartitions(*named)
        return rows.mapInArrow(follow([key], False), schema)
    unit = [key, SEGMENT]
    rows = durable(with_segments(narrow, [key], order, large, rows_per_task))
    # Per segment its first vector and its last two; over segments: what is before each one.
    place = F.struct(*order)
    last = Window.partitionBy(*unit).orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= 2).groupBy(*unit).agg(
        F.max(F.when(F.col("_back") == 1, F.col("_vector"))).alias("_a"), F.max(F.when(F.col("_back") == 2, F.col("_vector"))).alias("_b"))
    heads = rows.groupBy(*unit).agg(F.min_by("_vector", place).alias("_head"), F.count("*").alias("_n"))
    ends = join_null_safe(heads, tails, unit, "inner")
    earlier = Window.partitionBy(key).orderBy(SEGMENT)
    before = ends.select(
        *unit, F.first("_head").over(earlier).alias("_first"), F.lag("_a").over(earlier).alias("_last"),
        # The vector before the last one may lie a segment further back.
        F.coalesce(F.lag("_b").over(earlier), F.lag("_a", 2).over(earlier)).alias("_last2"),
        F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_turns"))
    before = before.withColumn("_similarity", F.when(F.col("_turns") > 1, vec.cosine(F.col("_last"), F.col("_last2"))).otherwise(0.0))
    before = before.withColumns({"_drift": F.lit(0.0), "_change": F.lit(0.0)}).drop("_last2")
    joined = join_null_safe(rows, before, unit, "left").repartition(*unit).sortWithinPartitions(*unit, *order)
    names = ("_first", "_last", "_similarity", "_turns", "_drift", "_change")
    # A segment's first row carries what is before it; the other rows need not.
    first_row = F.row_number().over(Window.partitionBy(*unit).orderBy(*order)) == 1
    sparse = joined.withColumn("_at", first_row).withColumns({c: F.when(F.col("_at"), F.col(c)) for c in names}).drop("_at")
    found = durable(sparse.mapInArrow(follow(unit, True), schema.replace(", similarity", f", `{SEGMENT}` long, similarity", 1)))
    tops = found.groupBy(*unit).agg(F.max("max_drift").alias("_d"), F.max("max_change_rate").alias("_c"))
    past = earlier.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*unit, F.max("_d").over(past).alias("_d"), F.max("_c").over(past).alias("_c"))
    both = join_null_safe(found, tops, unit, "left")
    return both.select(*named, "similarity", "drift", "change_rate", F.greatest("max_drift", "_d").alias("max_drift"),
                       F.greatest("max_change_rate", "_c").alias("max_change_rate"))


def conversation_drift(df: DataFrame, key: str, ts: str, row_id: str, embedding: str = "embedding",
                       rows_per_task: int | None = None) -> DataFrame:
    """Add, per turn of a key in the order of (ts, row_id): `similarity` to the
    previous turn (0 on the first), `drift` from the first turn (0 on the
    first), `change_rate` of the similarity (0 before the third turn), and the
    running `max_drift` and `max_change_rate`.

    Only the four named columns go through the ordered pass (`drift_values`); the values
    are joined back by `row_id`, which must be unique. Turns without a vector get nulls."""
    values = drift_values(df, key, ts, row_id, embedding, rows_per_task=rows_per_task)
    narrow = values.select(F.col(row_id).alias("_id"), *_VALUES)
    return df.join(narrow, F.col(row_id) == F.col("_id"), "left").drop("_id")


def alert_reason(drift_threshold: float, change_threshold: float) -> Column:
    """The text of an alert, or null; drift is looked at first."""
    def text(label: str, value: str, threshold: float) -> Column:
        return F.format_string(f"{label} (%.2f) exceeds threshold ({threshold:.2f})", F.col(value))

    return (
        F.when(F.col("drift") > drift_threshold, text("Context drift", "drift", drift_threshold))
        .when(F.col("change_rate") > change_threshold,
              text("Context change rate", "change_rate", change_threshold)))


def drift_alerts(df: DataFrame, key: str, ts: str, row_id: str, text: str, embedding: str = "embedding",
                 drift_threshold: float = rules.DRIFT_THRESHOLD,
                 change_threshold: float = rules.CHANGE_RATE_THRESHOLD,
                 rows_per_task: int | None = None) -> DataFrame:
    """Add `context_tracking` to every turn.

    Trivial turns are no part of a conversation's sequence and get fixed values. Only ids,
    times and one vector a turn are shuffled for the ordered pass; its values are joined
    back by `row_id`, which must be unique.  `is_suspicious` does
    not know about a cooldown; see `cooled_alerts`."""
    trivial = F.coalesce(is_trivial_turn(F.col(text)), F.lit(False))
    values = drift_values(df.where(~trivial), key, ts, row_id, embedding, rows_per_task=rows_per_task)
    values = values.withColumn("reason", alert_reason(drift_threshold, change_threshold)).select(
        F.col(row_id).alias("_id"), F.struct(*_VALUES, "reason").alias("_values"))
    joined = df.join(values, F.col(row_id) == F.col("_id"), "left")

    def of(name: str) -> Column:
        return F.col(f"_values.{name}").alias(name)

    return joined.select(*df.columns, F.struct(
        F.when(trivial, 0.0).otherwise(of("drift")).alias("drift"), F.when(trivial, 0.0).otherwise(of("change_rate")).alias("change_rate"),
        F.when(trivial, 1.0).otherwise(of("similarity")).alias("similarity"), of("max_drift"), of("max_change_rate"),
        F.col("_values.reason").isNotNull().alias("is_suspicious"), of("reason")).alias("context_tracking"))


def last_session(df: DataFrame, keys: list[str], ts: str, row_id: str, idle_seconds: float,
                 rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of each key behind its last pause of more than `idle_seconds`."""
    def pauses(rows: DataFrame, window) -> DataFrame:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        return rows.withColumn("_new", at - F.lag(at).over(window) > int(idle_seconds * 1e6))

    starts = Ordered(df.select(*keys, ts, row_id), keys, [ts, row_id], rows_per_task).look_back(1, pauses).rows()
    starts = starts.where("_new").groupBy(*keys).agg(F.max(ts).alias("_start"))
    rows = join_null_safe(df, starts, keys, "left")
    return rows.where(F.col("_start").isNull() | (F.col(ts) >= F.col("_start"))).drop("_start")


def drift_states(df: DataFrame, key: str, ts: str, row_id: str, embedding: str = "embedding",
                 drift_threshold: float = rules.DRIFT_THRESHOLD, change_threshold: float = rules.CHANGE_RATE_THRESHOLD,
                 alert_interval: float = rules.ALERT_INTERVAL, idle_seconds: float | None = None) -> DataFrame:
    """What a key's turns leave for the next one: `key, first, previous, similarity, n, alert`
    (seconds of the last alert that fired), `seen` (seconds of the last turn), `max_drift, max_change_rate`."""
    if idle_seconds is not None:
        df = last_session(df, [key], ts, row_id, idle_seconds)
    values = durable(drift_values(df, key, ts, row_id, embedding))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    alerts = values.where((F.col("drift") > drift_threshold) | (F.col("change_rate") > change_threshold))
    fired = cooldown(alerts, key, ts, row_id, alert_interval).where("fires").groupBy(key).agg(F.max(seconds).alias("alert"))
    place, vector = F.struct(ts, row_id), F.col(embedding).cast("array<double>")
    ends = df.where(F.size(embedding) > 0).groupBy(key).agg(F.min_by(vector, place).alias("first"), F.max_by(vector, place).alias("previous"))
    sums = values.groupBy(key).agg(
        F.max_by("similarity", place).alias("similarity"), F.count("*").alias("n"), F.max(seconds).alias("seen"),
        F.max("max_drift").alias("max_drift"), F.max("max_change_rate").alias("max_change_rate"))
    return join_null_safe(join_null_safe(sums, ends, [key], "inner"), fired, [key], "left")


def cooled_alerts(tracked: DataFrame, key: str, ts: str, row_id: str, seconds: float,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`context_tracking` with alerts suppressed that come less than `seconds`
    after the last one that fired.  Only the alerts are shuffled and looked at in
    order; `row_id` must be unique."""
    alerts = tracked.where("context_tracking.is_suspicious")
    fired = cooldown(alerts, key, ts, row_id, seconds, rows_per_task).where("fires").select(
        F.col(row_id).alias("_row"), F.lit(True).alias("_fires"))
    joined = tracked.join(fired, F.col(row_id) == F.col("_row"), "left")
    fires = F.coalesce(F.col("_fires"), F.lit(False))
    tracking = F.col("context_tracking")
    return joined.withColumn(
        "context_tracking", tracking.withField("is_suspicious", fires).withField(
            "reason", F.when(fires, tracking["reason"]))).drop("_row", "_fires")


# Up to this number Spark limits a ranked window before it shuffles.
_GROUP_LIMIT = 1000


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int,
            rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The first `n` rows per key, with their `rank`.

    Spark keeps at most `n` rows per key in each task before it shuffles (a
    window group limit), so a key of any size arrives as a small group.  Beyond
    the largest `n` it does this for, ranks come from segments."""
    if n <= _GROUP_LIMIT:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
    ranked = Ordered(df, keys, order, rows_per_task).running({"rank": ("sum", F.lit(1))})
    return ranked.rows().where(F.col("rank") <= n)


def last_n(df: DataFrame, key: str, ts: str, row_id: str, n: int = rules.HISTORY_TURNS,
           rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The last `n` rows per key; up to 1000 of them are limited before the shuffle, as in
    `first_n`, beyond that each key's rows are ranked by segments from the start, of which
    the last `n` are those above the key's count less `n`."""
    if n > _GROUP_LIMIT:
        ranked = Ordered(df, [key], [ts, row_id], rows_per_task).running({"_rank": ("sum", F.lit(1))}).rows()
        counts = df.groupBy(key).agg((F.count(F.lit(1)) - n).alias("_before"))
        return join_null_safe(ranked, counts, [key], "inner").where(F.col("_rank") > F.col("_before")).drop("_rank", "_before")
    latest = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(row_id))
    return df.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= n).drop("_rank")
