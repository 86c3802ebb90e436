"""Guards as plug-ins: column-building steps with a verdict each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass
class Guard:
    """A check over requests.

    `requires` are columns that must be filled; `apply` adds the guard's result
    column; `fails` says when a row is blocked.  `guard.apply` may be anything
    from a projection to a join, as long as it keeps the rows."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    fails: Callable[[], Column] = field(default=lambda: F.lit(False))
    requires: Sequence[str] = ()
    priority: int = 0
    enabled: bool = True


class GuardSuite:
    """Guards run by descending priority; the first that blocks is named.

    The order is fixed when the plan is built, and disabled guards leave no
    trace in it.  A guard that keeps state must not see blocked rows: it can
    look at `blocked_by`, which is null as long as a row has passed."""

    def __init__(self, guards: Sequence[Guard], limit: int | None = None) -> None:
        """Of guards with one name the last counts. All run; with a `limit`, more than that
        many are an error, since a guard must not go missing unseen."""
        by_name = {guard.name: guard for guard in guards}
        if limit is not None and len(by_name) > limit:
            raise ValueError(f"{len(by_name)} guards, and the limit is {limit}")
        self._guards = sorted(by_name.values(), key=lambda g: -g.priority)

    def names(self) -> list[str]:
        return [g.name for g in self._guards if g.enabled]

    def _set(self, name: str, enabled: bool) -> bool:
        for guard in self._guards:
            if guard.name == name:
                guard.enabled = enabled
                return True
        return False

    def enable(self, name: str) -> bool:
        return self._set(name, True)

    def disable(self, name: str) -> bool:
        return self._set(name, False)

    def apply(self, df: DataFrame) -> DataFrame:
        """`df` with the guards' results and `blocked_by` (null = passed)."""
        out = df.withColumn("blocked_by", F.lit(None).cast("string"))
        for guard in self._guards:
            if not guard.enabled:
                continue
            lacking = F.lit(False)
            for column in guard.requires:
                lacking = lacking | (F.col(column).isNull() if column in out.columns else F.lit(True))
            out = guard.apply(out)
            out = out.withColumn("blocked_by", F.coalesce(
                F.col("blocked_by"),
                F.when(lacking, F.lit(f"Input blocked by {guard.name}")),
                F.when(F.coalesce(guard.fails(), F.lit(False)), F.lit(f"Output blocked by {guard.name}"))))
        return out
