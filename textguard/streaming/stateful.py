"""Guards that keep state per key, on streams.

Rows are handled in the order of (time, id) within a slice of at most `SLICE_ROWS` rows of
a key (rate limits and usage caps: of a group of keys) and micro-batch (and one Arrow batch
more), in order of arrival across slices and micro-batches; no more is held at once.  A watermark must be set on the time
column: it drives the timers that drop the state of keys gone quiet, which all guards do
by default.  A stream can start from what batch operators made of earlier rows (`history`):
their last state per key is loaded in the first micro-batch, and nothing is replayed.

The processors are classes made inside functions, so that they travel to the
executors by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textguard import rules
from textguard.functions.text import is_trivial_turn
from textguard.operators.drift import alert_reason, drift_states, last_n, last_session
from textguard.operators.ratelimit import Limits, bucket_states, bucket_step, refill_seconds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State in RocksDB: larger than memory, and what `transformWithState` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Rows of a key that are sorted and held at once.
SLICE_ROWS = 100_000
#: Keys of short states share so many groups, each with its states in one value.
GROUPS = 1024
#: The microseconds that a missing time counts as.
NO_TIME = -9_223_372_036_854_776
#: A conversation or session without a row for so long is over, and its state goes.
IDLE_SECONDS = 30 * 86_400


def _slicer(limit: int):
    """A function for a key's rows of one micro-batch in slices, each in order."""
    def slices(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in rows:
            if len(part):
                held.append(part)
                n += len(part)
            if n >= limit:
                yield pd.concat(held).sort_values(order, kind="stable")
                held, n = [], 0
        if held:
            yield pd.concat(held).sort_values(order, kind="stable")

    return slices


def _in_groups(rows: DataFrame, keys: list[str], ts: str, row_id: str, extra: str | None, result: str,
               step: Callable, expiry: Callable | None, history: DataFrame | None, groups: int) -> DataFrame:
    """`keys, ts, row_id, result` of rows whose keys are dealt by hash into `groups` groups.

    A call of a processor takes milliseconds however few rows it gets, so keys with few rows share
    one, with one read and one write of the states of its keys.  `step` takes a row's time in
    microseconds, its `extra` and its key's state (None at first), and gives the result and the
    state, a tuple of numbers.  `expiry` gives the millisecond a state goes at; a group has a timer for its
    first one.  `history` has the keys and `dealt_state`, an array of doubles."""
    slices, order, out = _slicer(SLICE_ROWS), [ts, row_id], [*keys, ts, row_id]

    class Group(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._states = handle.getValueState("states", "names array<string>, states array<array<double>>")
            self._timer = handle.getValueState("timer", "at long")

        def _known(self) -> dict[str, tuple]:
            if not self._states.exists():
                return {}
            names, states = self._states.get()
            return {name: tuple(state) for name, state in zip(names, states)}

        def _keep(self, known: dict[str, tuple]) -> None:
            if known:
                self._states.update((list(known), [[float(x) for x in state] for state in known.values()]))
            else:
                self._states.clear()
            if expiry is None:
                return
            before = self._timer.get()[0] if self._timer.exists() else None
            first = min(map(expiry, known.values()), default=None)
            if first == before:
                return
            if before is not None:
                self._handle.deleteTimer(before)
            if first is None:
                self._timer.clear()
            else:
                self._handle.registerTimer(first)
                self._timer.update((first,))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            known = self._known()
            known.update((name, tuple(state)) for name, state in zip(initialState["dealt_key"], initialState["dealt_state"]))
            self._keep(known)

        def handleInputRows(self, key_values, rows, timerValues) -> Iterator[pd.DataFrame]:
            known = self._known()
            for some in slices(rows, order):
                found = []
                micros = (pd.to_datetime(some[ts]).to_numpy("datetime64[ns]").view("int64") // 1000).tolist()
                for name, moment, value in zip(some["dealt_key"], micros, some[extra] if extra else micros):
                    one, known[name] = step(moment, value, known.get(name))
                    found.append(one)
                yield some[out].assign(**{result: found})
            self._keep(known)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            until, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
            self._timer.clear()  # this timer goes by itself
            self._keep({name: state for name, state in self._known().items() if until < expiry(state) >= passed})
            return iter(())

        def close(self) -> None:
            pass

    def dealt(df: DataFrame) -> DataFrame:
        # Names of keys that tell null from text; no column names that start with an underscore, which are lost.
        name = F.to_json(F.struct(*keys))
        return df.withColumn("dealt_key", name).withColumn("dealt_group", F.pmod(F.xxhash64("dealt_key"), F.lit(groups)).cast("int"))

    fields = rows.select(*out).schema.add(result, "boolean")
    states = None if history is None else dealt(history).select("dealt_group", "dealt_key", "dealt_state")
    return dealt(rows).groupBy("dealt_group").transformWithStateInPandas(
        Group(), fields, "append", "None" if expiry is None else "EventTime", _grouped(states, "dealt_group"))


def _grouped(states: DataFrame | None, *keys: str):
    return None if states is None else states.groupBy(*keys)


def rate_limit_stream(requests: DataFrame, key: str, ts: str, row_id: str,
                      limits: Limits = rules.RATE_LIMITS, history: DataFrame | None = None,
                      groups: int = GROUPS) -> DataFrame:
    """Token buckets on a stream: `key, ts, row_id, allowed`.

    The state of a key is dropped once a pause has filled its buckets again,
    which is the same as never having seen it.  `history` holds earlier requests."""
    take, idle = bucket_step(limits), int(refill_seconds(limits) * 1000)
    states = None
    if history is not None:
        left = bucket_states(history, key, ts, row_id, limits)
        states = left.select(key, F.array(*[f"s{i}" for i in range(2 * len(limits))]).alias("dealt_state"))

    def step(micros, _, state):
        return take(micros, state)

    return _in_groups(requests.select(key, ts, row_id), [key], ts, row_id, None, "allowed", step,
                      lambda state: int(max(state[::2]) // 1000) + idle, states, groups)


def drift_stream(turns: DataFrame, key: str, ts: str, row_id: str, embedding: str = "embedding",
                 drift_threshold: float = rules.DRIFT_THRESHOLD,
                 change_threshold: float = rules.CHANGE_RATE_THRESHOLD,
                 alert_interval: float = rules.ALERT_INTERVAL,
                 idle_seconds: int | None = IDLE_SECONDS, text: str | None = None,
                 history: DataFrame | None = None) -> DataFrame:
    """Conversation drift on a stream of turns: `key, ts, row_id, similarity, drift,
    change_rate, max_drift, max_change_rate` (running maxima), `is_suspicious, reason`.

    State per key: first and previous embedding, previous similarity, number of
    turns, times of the last alert and turn, the maxima.  A pause of more than
    `idle_seconds` ends a conversation; with None it never ends.  Turns whose `text`
    is trivial get fixed values and are no part of the conversation.  `history` holds
    earlier turns, with the same columns.  Turns without a vector are left out."""
    slices = _slicer(SLICE_ROWS)
    trivial = F.coalesce(is_trivial_turn(F.col(text)), F.lit(False)) if text else F.lit(False)
    values = ("similarity", "drift", "change_rate", "max_drift", "max_change_rate", "is_suspicious")
    state_names = ("first", "previous", "similarity", "n", "alert", "seen", "max_drift", "max_change_rate")

    def cosine(a, b) -> float:
        lengths = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / lengths) if lengths > 0 else 0.0

    class Tracker(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._turns = handle.getValueState(
                "turns", "first array<double>, previous array<double>, similarity double, n long, alert double, seen double, "
                "max_drift double, max_change_rate double")
            self._timer = handle.getValueState("timer", "at long")

        def _keep(self, state: tuple) -> None:
            self._turns.update(state)
            if idle_seconds is not None:
                if self._timer.exists():
                    self._handle.deleteTimer(self._timer.get()[0])
                expiry = int((state[5] + idle_seconds) * 1000) + 1
                self._handle.registerTimer(expiry)
                self._timer.update((expiry,))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            row = initialState.iloc[0]
            alert = None if pd.isna(row["alert"]) else float(row["alert"])
            self._keep(([float(x) for x in row["first"]], [float(x) for x in row["previous"]], float(row["similarity"]), int(row["n"]), alert,
                        *[float(row[name]) for name in state_names[5:]]))

        def handleInputRows(self, key_values, rows, timerValues) -> Iterator[pd.DataFrame]:
            first = previous = last_alert = seen = None
            similarity, n, most, most_change = 0.0, 0, 0.0, 0.0
            if self._turns.exists():
                first, previous, similarity, n, last_alert, seen, most, most_change = self._turns.get()
                first, previous = np.array(first), np.array(previous)
            for some in slices(rows, [ts, row_id]):
                found = []
                for moment, vector, skip in zip(some[ts], some["drift_vector"], some["drift_trivial"]):
                    if skip:
                        found.append((1.0, 0.0, 0.0, None, None, False))
                        continue
                    vector = np.asarray(vector, dtype=np.float64)
                    seconds = pd.Timestamp(moment).value / 1e9
                    if idle_seconds is not None and seen is not None and seconds - seen > idle_seconds:
                        n, most, most_change = 0, 0.0, 0.0
                    seen = seconds
                    n += 1
                    drift = change = 0.0
                    if n == 1:
                        first, similarity = vector, 0.0
                    else:
                        before, similarity = similarity, cosine(vector, previous)
                        drift = 1.0 - cosine(vector, first)
                        change = abs(similarity - before) if n >= 3 else 0.0
                    previous = vector
                    # The first turn's values are the first maxima, whatever their sign.
                    most, most_change = (drift, change) if n == 1 else (max(most, drift), max(most_change, change))
                    quiet = last_alert is None or seconds - last_alert >= alert_interval
                    alert = quiet and (drift > drift_threshold or change > change_threshold)
                    last_alert = seconds if alert else last_alert
                    found.append((similarity, drift, change, most, most_change, alert))
                yield some[[key, ts, row_id]].assign(**{name: [f[i] for f in found] for i, name in enumerate(values)})
            if first is not None:
                self._keep((first.tolist(), previous.tolist(), similarity, n, last_alert, seen, most, most_change))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._turns.clear()
            self._timer.clear()
            return iter(())

        def close(self) -> None:
            pass

    # No names that start with an underscore: the stream's rows lose those.
    def narrow(df: DataFrame) -> DataFrame:
        vector = F.col(embedding).cast("array<double>")
        rows = df.select(key, ts, row_id, vector.alias("drift_vector"), trivial.alias("drift_trivial"))
        return rows.where(F.col("drift_trivial") | (F.size("drift_vector") > 0))

    fields = turns.select(key, ts, row_id).schema
    for name in values[:-1]:
        fields = fields.add(name, "double")
    fields = fields.add("is_suspicious", "boolean")
    states = None if history is None else drift_states(
        narrow(history).where("not drift_trivial"), key, ts, row_id, "drift_vector", drift_threshold, change_threshold, alert_interval, idle_seconds)
    tracked = narrow(turns).groupBy(key).transformWithStateInPandas(
        Tracker(), fields, "append", "EventTime" if idle_seconds is not None else "None", _grouped(states, key))
    return tracked.withColumn("reason", F.when(
        F.col("is_suspicious"), alert_reason(drift_threshold, change_threshold)))


def usage_cap_stream(passing: DataFrame, user: str, tool: str, ts: str, row_id: str, cap: str,
                     session_seconds: int | None = IDLE_SECONDS, history: DataFrame | None = None,
                     decided: str = "is_allowed", groups: int = GROUPS) -> DataFrame:
    """Usage caps on a stream of calls that pass all other checks: `user, tool,
    ts, row_id, is_allowed`.

    `cap` is a column (-1 = no limit).  Counts last until the user has left the
    tool alone for more than `session_seconds`; with None for ever.  `history` holds
    earlier calls with what was `decided` for them."""
    def step(micros, limit, state):
        used, last = state or (0, None)
        if session_seconds is not None and last is not None and micros - last > session_seconds * 1_000_000:
            used = 0
        ok = bool(limit < 0 or used < limit)
        return ok, (used + ok, micros)

    def expiry(state):
        return int(state[1]) // 1000 + session_seconds * 1000 + 1

    states = None
    if history is not None:
        rows = history.select(user, tool, ts, row_id, F.col(decided).alias("_decided"))
        if session_seconds is not None:
            rows = last_session(rows, [user, tool], ts, row_id, session_seconds)
        last = F.coalesce(F.max(F.unix_micros(F.col(ts).cast("timestamp"))), F.lit(NO_TIME))
        states = rows.groupBy(user, tool).agg(F.array(
            F.count_if("_decided").cast("double"), last.cast("double")).alias("dealt_state"))
    return _in_groups(passing.select(user, tool, ts, row_id, cap), [user, tool], ts, row_id, cap, "is_allowed", step,
                      None if session_seconds is None else expiry, states, groups)


def context_stream(requests: DataFrame, key: str, ts: str, row_id: str, text: str,
                   seconds: int = rules.CONTEXT_SECONDS, history: DataFrame | None = None) -> DataFrame:
    """Word overlap with the key's recent texts on a stream: `key, ts, row_id,
    context_score`.  The state holds at most three texts and goes with the last
    of them.  `history` holds earlier requests."""
    slices, keep = _slicer(SLICE_ROWS), rules.CONTEXT_TEXTS

    class Memory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._recent = handle.getValueState("recent", "at array<long>, texts array<string>")
            self._timer = handle.getValueState("timer", "at long")

        def _keep(self, recent: list) -> None:
            self._recent.update(([at for at, _ in recent], [t for _, t in recent]))
            if self._timer.exists():
                self._handle.deleteTimer(self._timer.get()[0])
            expiry = recent[-1][0] // 1000 + seconds * 1000
            self._handle.registerTimer(expiry)
            self._timer.update((expiry,))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self._keep([(int(r["at"]), r["text"]) for r in initialState["recent"].iloc[0]])

        def handleInputRows(self, key_values, rows, timerValues) -> Iterator[pd.DataFrame]:
            recent = list(zip(*self._recent.get())) if self._recent.exists() else []
            for some in slices(rows, [ts, row_id]):
                scores = []
                for moment, words in zip(some[ts], some[text]):
                    micros = pd.Timestamp(moment).value // 1000
                    own = set((words or "").lower().split())
                    known = {w for at, t in recent if micros - at < seconds * 1_000_000 for w in t.lower().split()}
                    union = own | known
                    scores.append(len(own & known) / len(union) if known and union else 0.0)
                    recent = [*recent, (micros, words or "")][-keep:]
                yield some[[key, ts, row_id]].assign(context_score=scores)
            if recent:
                self._keep(recent)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._recent.clear()
            self._timer.clear()
            return iter(())

        def close(self) -> None:
            pass

    fields = requests.select(key, ts, row_id).schema.add("context_score", "double")
    states = None
    if history is not None:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        states = last_n(history.select(key, ts, row_id, text), key, ts, row_id, keep).groupBy(key).agg(F.transform(
            F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col(row_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")))),
            lambda r: F.struct(r["at"].alias("at"), r["text"].alias("text"))).alias("recent"))
    return requests.select(key, ts, row_id, text).groupBy(key).transformWithStateInPandas(
        Memory(), fields, "append", "EventTime", _grouped(states, key))
