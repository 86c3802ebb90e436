"""Ordered per-key computations that survive a key with a third of all rows.

A window partitioned by key puts all rows of a key into one task.  So every
function here first counts rows per key (one aggregation over the key column).
If no key exceeds `rows_per_task`, it runs the plain window.  Otherwise the rows
of the large keys are cut into consecutive segments of bounded size, computed
side by side, and joined up through one summary row or a few border rows per
segment.  The results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textguard.durable import durable, shuffle_parts

ROWS_PER_TASK = 5_000_000
_FANOUT = 256
_LEVELS = 12
SEGMENT = "_segment"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on `keys` in which null equals null; keeps the keys of `left`."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def large_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> DataFrame | None:
    """The keys with more than `rows_per_task` rows, or None if there are none.

    At most total / rows_per_task rows, since each stands for that many."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = durable(counts.where(F.col("_rows") > rows_per_task).drop("_rows"))
    return None if large.isEmpty() else large


def micros(df: DataFrame, column: str) -> Column:
    """A timestamp column as microseconds.  Timestamps without zone are taken as
    they read, so that no change of clocks in the session's zone disturbs their
    order or the time between them."""
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp"))
    days = F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{column}`)") * 1_000_000).cast("long")


def _text_position(text: Column, skip: Column) -> Column:
    """The six bytes behind the first `skip` as a number, which grows with the text."""
    six = F.rpad(F.hex(F.substring(text.cast("binary"), skip + 1, F.lit(6))), 12, "0")
    return F.conv(six, 16, 10).cast("double")


def _common_bytes(a: Column, b: Column) -> Column:
    """How many bytes two texts have in common at the start."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    pairs = F.sequence(F.lit(0), n)  # 0 stands for itself: no bytes are always common
    same = F.filter(pairs, lambda i: F.substring(a.cast("binary"), F.lit(1), i) == F.substring(b.cast("binary"), F.lit(1), i))
    return F.array_max(same)


def _position(df: DataFrame, column: str) -> Column | None:
    """A number that grows with an order column; for texts, behind the `_skip` bytes that
    the rows of a range have in common."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return _text_position(F.col(column), F.coalesce("_skip", F.lit(0)))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(df, column).cast("double")
    return F.col(column).cast("double") if isinstance(kind, T.NumericType) else None


def with_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  large: DataFrame, rows_per_task: int) -> DataFrame:
    """Add `_segment`: consecutive numbers within a large key, 0 for other keys.

    Large keys are cut by equal ranges of the first order column; ranges that
    are still too full are cut again, by the same column for as long as they hold
    several of its values and then by the next one, so that rows bunched in time or
    on one timestamp are spread as well.  Texts are cut by the bytes behind those
    that all rows of a range share.
    A histogram of the ranges, summed up per key, gives the segment.  Ranges and
    histogram hold a few rows per `rows_per_task` rows of a large key and are
    written out, so that every later use of a row sees the same segment.
    """
    rows = join_null_safe(df, large.withColumn("_large", F.lit(True)), keys, "left")
    path: list[str] = []
    for place, column in enumerate(order):
        position = _position(df, column)
        if position is None:
            break
        text = isinstance(df.schema[column].dataType, (T.StringType, T.BinaryType))
        least, most = (F.min(column), F.max(column)) if text else (F.min(position), F.max(position))
        # A range is cut by a column only if it holds one value of each column before it.
        one = [F.min(c).eqNullSafe(F.max(c)).alias(f"_one{k}") for k, c in enumerate(order[:place])]
        for _ in range(_LEVELS):
            group = [*keys, *path]
            full = rows.where("_large").groupBy(*group).agg(
                F.count(F.lit(1)).alias("_n"), least.alias("_lo"), most.alias("_hi"), *one).where(F.col("_n") > rows_per_task)
            for k in range(len(one)):
                full = full.where(F.col(f"_one{k}")).drop(f"_one{k}")
            full = full.drop("_n").withColumn("_skip", F.lit(0))
            if text:
                full = full.withColumn("_skip", _common_bytes(F.col("_lo"), F.col("_hi")))
                full = full.withColumns({c: _text_position(F.col(c), F.col("_skip")) for c in ("_lo", "_hi")})
            full = durable(full.where("_lo < _hi"))
            if full.isEmpty():
                break
            # The last range takes what rounding leaves over.
            share = (position - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
            name = f"_range{len(path)}"
            rows = (
                join_null_safe(rows, full, group, "left")
                .withColumn(name, F.coalesce(F.least(F.floor(share * _FANOUT), F.lit(_FANOUT - 1)), F.lit(0)))
                .drop("_lo", "_hi", "_skip")
            )
            path.append(name)
    if not path:
        return rows.drop("_large").withColumn(SEGMENT, F.lit(0).cast("long"))
    before = Window.partitionBy(*keys).orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    histogram = rows.where("_large").groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("_n"))
    segments = durable(histogram.select(*keys, *path, F.floor(
        F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows_per_task).alias(SEGMENT)))
    return (
        join_null_safe(rows, segments, [*keys, *path], "left")
        .withColumn(SEGMENT, F.coalesce(F.col(SEGMENT), F.lit(0)))
        .drop("_large", *path)
    )


# How each running value is computed in a frame, summed up per segment, and
# joined with what the earlier segments hold.
def _in_frame(kind: str, value: Column, frame: WindowSpec) -> Column:
    if kind == "max":
        return F.max(value).over(frame)
    if kind == "sum":
        return F.coalesce(F.sum(value).over(frame), F.lit(0))
    if kind == "first":
        return F.first(value, ignorenulls=True).over(frame)
    return F.last(value, ignorenulls=True).over(frame)


def _summary(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind == "max":
        return F.max(value)
    if kind == "sum":
        return F.sum(value)
    place = F.when(value.isNotNull(), F.struct(*order))
    return F.min_by(value, place) if kind == "first" else F.max_by(value, place)


def _combined(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "max":
        return F.greatest(earlier, here)
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + here
    return F.coalesce(earlier, here) if kind == "first" else F.coalesce(here, earlier)


class Ordered:
    """Rows of a table in order within their key, ready for windows.

    Key sizes are counted and segments formed once; each step adds columns and
    returns the rows for the next one.  `rows()` gives the plain table back.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 rows_per_task: int = ROWS_PER_TASK) -> None:
        self.keys, self.order = list(keys), list(order)
        large = large_keys(df.select(*keys), keys, rows_per_task)
        self.split = large is not None
        self._df = with_segments(df, keys, order, large, rows_per_task) if self.split else df

    def rows(self) -> DataFrame:
        return self._df.drop(SEGMENT)

    def _next(self, df: DataFrame) -> Ordered:
        """The same keys over new rows.  Segments use their rows more than once,
        so there each step is written out; the plain path stays one lazy plan."""
        following = copy(self)
        following._df = durable(df) if self.split else df
        return following

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        following = copy(self)
        following._df = self._df.withColumns(columns)
        return following

    def look_back(self, rows: int, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> Ordered:
        """Apply `add(df, window)`, which may look at most `rows` rows back (`lag`).

        In segments, the first `rows` rows lack their predecessors.  These rows
        and the last `rows` of each segment are taken together per key: a small
        set in which the former find exactly the predecessors they have in the
        whole key."""
        whole = Window.partitionBy(*self.keys).orderBy(*self.order)
        if not self.split:
            return self._next(add(self._df, whole))
        part = Window.partitionBy(*self.keys, SEGMENT).orderBy(*self.order)
        backwards = Window.partitionBy(*self.keys, SEGMENT).orderBy(*[F.desc(c) for c in self.order])
        placed = self._df.withColumn("_place", F.row_number().over(part))
        border = placed.withColumn("_left", F.row_number().over(backwards)).where(
            (F.col("_place") <= rows) | (F.col("_left") <= rows)).drop("_left")
        inner = add(placed, part).where(F.col("_place") > rows)
        outer = add(border, whole).where(F.col("_place") <= rows)
        return self._next(inner.unionByName(outer).drop("_place"))

    def running(self, values: dict[str, tuple[str, Column]], inclusive: bool = True) -> Ordered:
        """Add running values over a key's rows up to the current one.

        `values` maps a new column to (kind, expression) with kind one of max,
        sum, first, last (the latter two skip nulls).  With `inclusive=False`
        the frame ends before the current row."""
        end = 0 if inclusive else -1
        part = [*self.keys, SEGMENT] if self.split else self.keys
        frame = (Window.partitionBy(*part).orderBy(*self.order)
                 .rowsBetween(Window.unboundedPreceding, end))
        local = self._df.withColumns({n: _in_frame(k, v, frame) for n, (k, v) in values.items()})
        if not self.split:
            return self._next(local)
        sums = self._df.groupBy(*part).agg(
            *[_summary(k, v, self.order).alias(f"_all_{n}") for n, (k, v) in values.items()])
        earlier = (Window.partitionBy(*self.keys).orderBy(SEGMENT)
                   .rowsBetween(Window.unboundedPreceding, -1))
        carried = sums.select(*part, *[
            _in_frame(k, F.col(f"_all_{n}"), earlier).alias(f"_before_{n}") for n, (k, _) in values.items()])
        joined = join_null_safe(local, carried, part, "left")
        return self._next(joined.withColumns({
            n: _combined(k, F.col(f"_before_{n}"), F.col(n)) for n, (k, _) in values.items()
        }).drop(*[f"_before_{n}" for n in values]))


# A kernel takes the times (microseconds) of consecutive rows of one key and the
# state before them (None = none), and returns the output columns and the state
# after the last row.  It must be a closure: closures travel to executors by value.
Kernel = Callable[[list[int], tuple | None], tuple[dict[str, list], tuple]]


def _sequential(keys: Sequence[str], state: Sequence[str], schema: pa.Schema, kernel: Kernel):
    """A `mapInArrow` function over rows sorted by key and time.

    It holds one Arrow batch and one state at a time, however many rows a key
    has, and carries the state over batch borders."""
    def run_ends(batch: pa.RecordBatch) -> list[int]:
        """Where the key changes, found column by column (null equals null)."""
        n = batch.num_rows
        changed = np.zeros(max(n - 1, 0), dtype=bool)
        for name in keys:
            here, following = batch.column(name).slice(0, n - 1), batch.column(name).slice(1)
            same = pc.if_else(pc.and_(here.is_null(), following.is_null()), True,
                              pc.fill_null(pc.equal(here, following), False))
            changed |= ~same.to_numpy(zero_copy_only=False)
        return [*(np.nonzero(changed)[0] + 1).tolist(), n]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            micros = batch.column("_micros").to_pylist()
            added: dict[str, list] = {}
            start = 0
            for end in run_ends(batch):
                key = tuple(batch.column(k)[start].as_py() for k in keys)
                if key != last_key:
                    given = tuple(batch.column(f"_in_{s}")[start].as_py() for s in state)
                    last_key, last_state = key, None if None in given else given
                columns, last_state = kernel(micros[start:end], last_state)
                for name, cells in columns.items():
                    added.setdefault(name, []).extend(cells)
                for name, value in zip(state, last_state):
                    added.setdefault(f"_out_{name}", []).extend([None] * (end - start - 1) + [value])
                start = end
            yield pa.RecordBatch.from_arrays([
                pa.array(added[f.name], f.type) if f.name in added else batch.column(f.name)
                for f in schema], schema=schema)
    return fold


def _run_kernel(rows: DataFrame, keys: Sequence[str], order: Sequence[str], state: Sequence[str],
                outputs: str, kernel: Kernel) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != "_micros" and not f.name.startswith("_in_")]
    added = T._parse_datatype_string(outputs).fields
    after = [T.StructField(f"_out_{s}", T.DoubleType()) for s in state]
    schema = T.StructType([*kept, *added, *after])
    # A fixed number of parts: adaptive execution would go by bytes and put these
    # narrow rows, which take long to work on, into few tasks.
    parts = shuffle_parts(rows.sparkSession)
    sorted_rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(_sequential(keys, state, to_arrow_schema(schema), kernel), schema)


def sequential(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Sequence[str],
               outputs: str, kernel: Kernel, reset_seconds: float,
               rows_per_task: int = ROWS_PER_TASK, keep_state: bool = False) -> DataFrame:
    """Run a computation in which each row depends on the state its predecessor left.

    `df` should hold only keys and order columns; the first order column is the
    time.  `outputs` is the schema of the kernel's columns; `state` names its
    state values (doubles).  With `keep_state` they come out as `_out_<name>` on
    some rows, the last one of each key among them, and are null on the others.

    A pause of `reset_seconds` must bring any state back to the initial one.
    Large keys are cut there, which gives independent pieces.  A piece that is
    still too large is processed segment by segment: one round per segment, all
    pieces side by side, each round starting from the states the last one left.
    """
    empty = {f"_in_{s}": F.lit(None).cast("double") for s in state}
    rows = df.withColumn("_micros", micros(df, order[0]))
    after = [] if keep_state else [f"_out_{s}" for s in state]
    large = large_keys(df.select(*keys), keys, rows_per_task)
    if large is None:
        return _run_kernel(rows.withColumns(empty), keys, order, state, outputs, kernel).drop(*after)

    def cut_at_pauses(d: DataFrame, window: WindowSpec) -> DataFrame:
        pause = F.col("_micros") - F.lag("_micros").over(window) >= int(reset_seconds * 1e6)
        return d.withColumn("_cut", F.coalesce(pause, F.lit(True)).cast("long"))

    pieces = (Ordered(rows, keys, order, rows_per_task).look_back(1, cut_at_pauses)
              .running({"_piece": ("sum", F.col("_cut"))}).rows().drop("_cut"))
    unit = [*keys, "_piece"]
    large_pieces = large_keys(pieces.select(*unit), unit, rows_per_task)
    if large_pieces is None:
        return _run_kernel(pieces.withColumns(empty), unit, order, state, outputs, kernel).drop("_piece", *after)
    cut = with_segments(pieces, unit, order, large_pieces, rows_per_task)
    segmented = durable(cut.repartition(SEGMENT, *unit), SEGMENT)
    rounds = segmented.agg(F.max(SEGMENT)).first()[0] + 1
    done, carried = None, None
    for segment in range(rounds):
        part = segmented.where(F.col(SEGMENT) == segment).drop(SEGMENT)
        if carried is None:
            part = part.withColumns(empty)
        else:
            part = join_null_safe(part, carried, unit, "left")
        # A piece's last row holds the state it leaves.
        result = durable(_run_kernel(part, unit, order, state, outputs, kernel))
        done = result if done is None else done.unionByName(result)
        ends = result.groupBy(*unit).agg(*[
            F.max_by(f"_out_{s}", F.struct(*order)).alias(f"_in_{s}") for s in state])
        # A piece may have no rows in a segment number that others do have.
        if carried is not None:
            ends = ends.unionByName(join_null_safe(carried, ends.select(*unit), unit, "left_anti"))
        carried = durable(ends)
    return done.drop("_piece", *after)
