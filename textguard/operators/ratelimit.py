"""Token buckets and alert cooldown in batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.operators.ordered import ROWS_PER_TASK, sequential

Limits = Sequence[tuple[str, float, float]]


def bucket_step(limits: Limits) -> Callable[[int, tuple | None], tuple[bool, tuple]]:
    """A function for one request against the buckets in order.

    State: (last use in microseconds, tokens) per bucket.  Each bucket reached is
    refilled and marked as used, then pays one token; the first that cannot pay
    denies, and later buckets are left alone.  Tokens paid before a denial stay paid.

    It is a closure, so that it travels to the executors by value.
    """
    buckets = [(2 * i, cap, rate) for i, (_, cap, rate) in enumerate(limits)]

    def step(micros: int, state: tuple | None) -> tuple[bool, tuple]:
        now = float(micros)
        after = list(state) if state is not None else [v for _, cap, _ in buckets for v in (now, cap)]
        for i, cap, rate in buckets:
            tokens = after[i + 1] + (now - after[i]) / 1e6 * rate
            if tokens > cap:
                tokens = cap
            after[i] = now
            if tokens < 1.0:
                after[i + 1] = tokens
                return False, tuple(after)
            after[i + 1] = tokens - 1.0
        return True, tuple(after)

    return step


def refill_seconds(limits: Limits) -> float:
    """A pause after which every bucket is full, with room for rounding."""
    return max(cap / rate for _, cap, rate in limits) * 1.001 + 1.0


def _bucket_names(limits: Limits) -> list[str]:
    return [part for name, _, _ in limits for part in (f"{name}_last", f"{name}_left")]


def _limited(df: DataFrame, key: str, ts: str, row_id: str, limits: Limits, rows_per_task: int, keep_state: bool) -> DataFrame:
    names = [f"{name}_tokens" for name, _, _ in limits]
    step = bucket_step(limits)

    def kernel(micros, before):
        allowed, left = [], [[] for _ in names]
        for moment in micros:
            ok, before = step(moment, before)
            allowed.append(ok)
            for column, tokens in zip(left, before[1::2]):
                column.append(tokens)
        return {"allowed": allowed, **dict(zip(names, left))}, before

    schema = ", ".join(["allowed boolean", *[f"{n} double" for n in names]])
    return sequential(df.select(key, ts, row_id), [key], [ts, row_id], _bucket_names(limits), schema, kernel,
                      refill_seconds(limits), rows_per_task, keep_state)


def rate_limit(df: DataFrame, key: str, ts: str, row_id: str,
               limits: Limits = rules.RATE_LIMITS,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per request: `key, ts, row_id, allowed`, and tokens left per bucket.

    Only the three columns are shuffled; join the result back on `row_id`.
    Requests count in the order of (ts, row_id).
    """
    return _limited(df, key, ts, row_id, limits, rows_per_task, False)


def bucket_states(df: DataFrame, key: str, ts: str, row_id: str, limits: Limits = rules.RATE_LIMITS,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The buckets each key is left with: `key, s0, s1, ...`, as `bucket_step` takes them."""
    rows = _limited(df, key, ts, row_id, limits, rows_per_task, True)
    names = _bucket_names(limits)
    state = F.struct(*[F.col(f"_out_{name}").alias(f"s{i}") for i, name in enumerate(names)])
    return rows.where(F.col(f"_out_{names[0]}").isNotNull()).groupBy(key).agg(
        F.max_by(state, F.struct(ts, row_id)).alias("_state")).select(key, "_state.*")


def cooldown(alerts: DataFrame, key: str, ts: str, row_id: str, seconds: float,
             rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per alert: `key, ts, row_id, fires`.

    An alert fires unless fewer than `seconds` have passed since the last one
    of its key that fired.
    """
    def kernel(micros, before):
        last = before[0] if before is not None else None
        fires = []
        for moment in micros:
            fire = last is None or (moment - last) / 1e6 >= seconds
            last = float(moment) if fire else last
            fires.append(fire)
        return {"fires": fires}, (last,)

    return sequential(alerts.select(key, ts, row_id), [key], [ts, row_id], ["last_fired"],
                      "fires boolean", kernel, seconds, rows_per_task)
