"""Agent states over time: order of turns, allowed transitions, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.ordered import ROWS_PER_TASK, Ordered


def turn_order(df: DataFrame, key: str, ts: str, row_id: str, turn: str,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `temporal_violation`: the turn number does not exceed all earlier ones."""
    seen = Ordered(df, [key], [ts, row_id], rows_per_task).running(
        {"_seen": ("max", F.col(turn))}, inclusive=False).rows()
    return seen.withColumn(
        "temporal_violation", F.coalesce(F.col(turn) <= F.col("_seen"), F.lit(False))).drop("_seen")


def _removed(before: Column, now: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(before, none), F.coalesce(now, none))) > 0


def state_transitions(df: DataFrame, key: str, ts: str, row_id: str, goals: str = "goals",
                      constraints: str = "constraints", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `violations`: constraints or goals of the previous state are gone."""
    def previous(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("_goals", F.lag(goals).over(window)).withColumn(
            "_constraints", F.lag(constraints).over(window))

    linked = Ordered(df, [key], [ts, row_id], rows_per_task).look_back(1, previous).rows()
    return linked.withColumn("violations", F.array_compact(F.array(
        F.when(_removed(F.col("_constraints"), F.col(constraints)), F.lit("invalid_state_transition")),
        F.when(_removed(F.col("_goals"), F.col(goals)), F.lit("goal_violation")),
    ))).drop("_goals", "_constraints")


def state_hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def restore_states(df: DataFrame, key: str, ts: str, row_id: str, state: str,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `restored_from`: for a missing state, the hash of the key's last known one.

    `state` is a hash column, null where the state is missing or corrupt."""
    known = Ordered(df, [key], [ts, row_id], rows_per_task).running(
        {"_known": ("last", F.col(state))}, inclusive=False).rows()
    return known.withColumn("restored_from", F.when(F.col(state).isNull(), F.col("_known"))).drop("_known")


def sequential_pattern(df: DataFrame, similarity: str, threshold: float) -> DataFrame:
    """Add `sequential_pattern`: the input repeats the user's recent ones."""
    return df.withColumn("sequential_pattern", F.col(similarity) >= threshold)
