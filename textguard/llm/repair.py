"""Repair of the turn structure of conversations at the least cost.

A conversation is well-formed if the initials of its roles read `(s?(ua)+)?`: a system
turn or none, then pairs of user and assistant. Its turns are edited in order: Keep,
Rerole to user or assistant, Delete, Insert an empty user or assistant turn. Blank turns
and repetitions of an earlier turn must go; a truncated turn that stays costs extra.

The cheapest edits, and of equally cheap ones those whose letters D, I, K, R come first in
ASCII order, are a shortest path through a graph of turns and states of the grammar, from
the end to the start. A path's weight is one integer: its high digits are the cost, its
low digits, fixed in number, the letters from the highest place on, with zeros behind the
last. An edge in front of a path adds its cost above and puts its letter in the highest
low place, moving the others down by one. So the least integer decides cost and ties at
once, and its digits are the edits.

Integers stay short: turns are taken in blocks of `BLOCK`, and what follows a block enters
it as its cost and, for the ties, its rank among the four states in one digit. That is exact
where all cheapest paths have as many letters as turns, that is, no Insert: if an Insert
costs more than two Deletes, deleting its partner (and a system turn left alone) is cheaper.
For other costs a conversation is one block, with steps that grow with its square.

A conversation is one sorted run of rows in one task, read in Arrow batches: its turns take
a byte each and its edits a letter each (as the output's column does), its texts are never
gathered. Rows come by turn (nulls first), then role and text; null roles and texts are
empty; repeated rows are repetitions. An empty role has no initial and cannot be kept. A
null conversation id is a conversation of its own. Only the named columns are read. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.shipping import ship, worker_cache

ship(__name__)

BLOCK = 256
WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
#: Letters of the edits by their digits; 0 is no letter.
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
#: Code of a row that only names its conversation.
ABSENT = 127
#: States: nothing yet, behind a system turn, behind a user's, behind an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn that is rerolled or inserted becomes.
NEXT = (USER, USER, ASSISTANT, USER)
#: States a kept turn leads to, by its initial (0: none of the three); None: it does not fit.
KEPT = ((None, SYSTEM, USER, None), (None, None, USER, None), (None, None, None, ASSISTANT), (None, None, USER, None))
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class _Weights:
    """Weights of paths with at most `places` letters."""

    def __init__(self, places: int):
        self.places, self.low = places, 3 * places
        self.mask = (1 << self.low) - 1

    def before(self, path: int | None, letter: int, cost: int) -> int | None:
        """The weight of an edge in front of a path; none if there is no path."""
        if path is None:
            return None
        return (((path >> self.low) + cost) << self.low) | (letter << (self.low - 3)) | ((path & self.mask) >> 3)

    def letters(self, path: int) -> str:
        return f"{path & self.mask:0{self.places}o}"


def _least(*paths: int | None) -> int | None:
    return min((p for p in paths if p is not None), default=None)


def _with_inserts(paths: list, weights: _Weights, cost: int) -> list:
    """Paths that may begin with Inserts; more than two in a row come back to a state for nothing."""
    out = paths
    for _ in range(2):
        out = [_least(paths[q], weights.before(out[NEXT[q]], INSERT, cost)) for q in range(4)]
    return out


def _through(codes: bytes, after: list, weights: _Weights, costs: Costs) -> list:
    """Least paths per state from before the turns `codes` on, given those behind them."""
    paths = after
    for code in reversed(codes):
        initial, fault = code & 3, code >> 2
        extra = costs.truncated if fault == 3 else 0
        ahead = []
        for q in range(4):
            best = weights.before(paths[q], DELETE, costs.delete)
            if fault not in (1, 2):
                kept = KEPT[q][initial]
                best = _least(best, weights.before(paths[NEXT[q]], REROLE, costs.rerole + extra),
                              None if kept is None else weights.before(paths[kept], KEEP, extra))
            ahead.append(best)
        paths = _with_inserts(ahead, weights, costs.insert)
    return paths


def step(state: int, letter: str, initial: int) -> int:
    """The state behind an edit."""
    if letter == "D":
        return state
    return KEPT[state][initial] if letter == "K" else NEXT[state]


def cheapest(codes: bytes, costs: Costs = Costs(), block: int = BLOCK) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of turns, given by codes: the initial (0 none,
    1 s, 2 u, 3 a) plus four times the fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    if costs.insert <= 2 * costs.delete:
        block = max(1, len(codes))
    size = min(block, max(1, len(codes)))
    # Letters of a block: its turns, Inserts that pay, some to spare, and the rank of what follows.
    weights = _Weights(size + 8 + costs.delete * size // max(costs.insert, 1))
    blocks = [codes[at: at + size] for at in range(0, len(codes), size)]
    paths = _with_inserts([0, None, None, 0], weights, costs.insert)
    found = []
    for k, part in enumerate(reversed(blocks)):
        if k:
            ranks = sorted({p & weights.mask for p in paths if p is not None})
            paths = [None if p is None else (p >> weights.low << weights.low) | (ranks.index(p & weights.mask) + 1) << (weights.low - 3)
                     for p in paths]
        paths = _through(part, paths, weights, costs)
        found.append(paths)
    if not found:
        return 0, ""
    cost, state, audit = found[-1][START] >> weights.low, START, []
    for k, part in enumerate(blocks):
        digits, at, own = weights.letters(found[-1 - k][state]), 0, len(part)
        for digit in digits:
            if digit == "0" or (at == own and k + 1 < len(blocks)):
                break
            letter = LETTERS[int(digit)]
            audit.append(letter)
            state = step(state, letter, 0 if letter == "I" else part[at] & 3)
            at += letter != "I"
    return cost, "".join(audit)


def _remembered(codes: bytes, costs: Costs) -> tuple[int, str]:
    """`cheapest`, with what short conversations came to kept by the worker."""
    if len(codes) > 64:
        return cheapest(codes, costs)
    cache = worker_cache("repair")
    if (codes, costs) not in cache:
        if len(cache) >= 100_000:
            cache.clear()
        cache[codes, costs] = cheapest(codes, costs)
    return cache[codes, costs]


def _runs(column: pa.Array) -> list[int]:
    """Starts of the runs of equal values (nulls are equal), and the end."""
    n = len(column)
    if not n:
        return [0]
    a, b = column.slice(1), column.slice(0, n - 1)
    differ = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.fill_null(pc.not_equal(a, b), True), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
    return [0, *[k + 1 for k, d in enumerate(differ.to_pylist()) if d], n]


class _Conversation:
    """What is known of a conversation while its rows pass."""

    def __init__(self):
        self.codes, self.least, self.last, self.turns = bytearray(), None, None, 0

    def add(self, turns: list, codes: list) -> None:
        for turn, code in zip(turns, codes, strict=True):
            if code == ABSENT:
                continue
            self.codes.append(code)
            if turn is not None and turn != self.last:  # turns ascend
                self.least = turn if self.least is None else self.least
                self.last, self.turns = turn, self.turns + 1

    def summary(self, costs: Costs) -> tuple:
        codes = bytes(self.codes)
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        faults = [sum(code >> 2 == k for code in codes) for k in (1, 2, 3)]
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes[:-1], codes[1:], strict=True))
        cost, audit = _remembered(codes, costs)
        return (gaps, *faults, illegal, cost, audit)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, absent: Column | None) -> DataFrame:
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.lit(False) if absent is None else absent, F.lit(False)).alias("absent"))


def assess(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           absent: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """Per conversation conv, gaps in its turns, counts of faults (a turn's first one counts),
    illegal neighbours, cost and audit (the letters of the cheapest edits). Rows where `absent`
    holds are no turns; a conversation that has only such rows is returned as an empty one."""
    rows = _rows(turns, conv, turn, role, text, absent).repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "role", "text", "absent").orderBy("turn")) > 1
    bare = F.btrim("text", F.lit(WHITE))
    fault = F.when(bare == "", 1).when(again, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("absent"), ABSENT).otherwise(
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + 4 * fault)
    rows = rows.withColumn("code", code).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").select("conv", "turn", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, state, kind = None, None, None

        def out(done: list) -> pa.RecordBatch:
            columns = list(zip(*[s for _, s in done], strict=True))
            return pa.record_batch(
                [pa.concat_arrays([c for c, _ in done]), *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())],
                ["conv", *[f.split(" ")[0] for f in _SUMMARY.split(", ")]])

        for batch in batches:
            ids, kind, done = batch.column(0), batch.schema.field(0).type, []
            number, codes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cuts = _runs(ids)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = ids.slice(a, 1)
                if state is None or not own.equals(open_conv):
                    if state is not None:
                        done.append((open_conv, state.summary(costs)))
                    open_conv, state = own, _Conversation()
                state.add(number[a:b], codes[a:b])
            if done:
                yield out(done)
        if state is not None:
            yield out([(open_conv, state.summary(costs))])

    return rows.mapInArrow(run, f"conv {rows.schema['conv'].dataType.simpleString()}, {_SUMMARY}")


def repaired(turns: DataFrame, assessed: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", absent: Column | None = None) -> DataFrame:
    """The repaired turns: conv, place, role, text, edit (K, R or I). In front of those of each
    conversation, in the same task, stands a row with place 0 and its `assess`ment, else null."""
    rows = _rows(turns, conv, turn, role, text, absent).where("not absent").drop("absent")
    fields = [f.split(" ")[0] for f in _SUMMARY.split(", ")]
    none = F.lit(None)
    both = assessed.select("conv", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
                           F.lit(0).alias("kind"), *fields)
    both = both.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("conv")
    both = both.sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "text").drop("turn")
    names = {USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, START, 0
        for batch in batches:
            columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names) if name in ("role", "text", "kind", "audit")}
            made: list[tuple] = []  # row of the batch its id and summary come from, place, role, text, edit

            def inserted(row: int) -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    state, at, place = NEXT[state], at + 1, place + 1
                    made.append((row, place, names[state], "", "I"))

            for k, kind in enumerate(columns["kind"]):
                if kind == 0:
                    audit, at, state, place = columns["audit"][k], 0, START, 0
                    made.append((k, 0, None, None, None))
                    inserted(k)
                    continue
                letter, name = audit[at], columns["role"][k]
                at += 1
                if letter != "D":
                    state = step(state, letter, " sua".find(name[:1]))
                    place += 1
                    made.append((k, place, name if letter == "K" else names[state], columns["text"][k], letter))
                inserted(k)
            rows_of = pa.array([m[0] for m in made], pa.int32())
            heads = pa.array([m[0] if m[1] == 0 else None for m in made], pa.int32())
            yield pa.record_batch(
                [batch.column(0).take(rows_of), *[pa.array([m[j] for m in made], t) for j, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string()))],
                 *[batch.column(batch.schema.get_field_index(f)).take(heads) for f in fields]],
                ["conv", "place", "role", "text", "edit", *fields])

    return both.mapInArrow(run, f"conv {both.schema['conv'].dataType.simpleString()}, place long, role string, text string, edit string, {_SUMMARY}")


def digest(turns: DataFrame) -> DataFrame:
    """Per conversation its assessment and repaired_sha256, of `role:text` of the `repaired` turns
    with line feeds between. Rows are hashed as they come, so `turns` must come from `repaired`."""
    fields = [f.split(" ")[0] for f in _SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state = None, None
        for batch in batches:
            done, hashes = [], []
            for k, (place, role, text) in enumerate(zip(*[batch.column(j).to_pylist() for j in (1, 2, 3)], strict=True)):
                if place == 0:
                    if head is not None:
                        done.append(head)
                        hashes.append(state.hexdigest())
                    head, state = batch.slice(k, 1).select(["conv", *fields]), hashlib.sha256()
                else:
                    state.update(("\n" * (place > 1) + role + ":" + text).encode())
            if done:
                yield _hashed(done, hashes)
        if head is not None:
            yield _hashed([head], [state.hexdigest()])

    def _hashed(heads: list, hashes: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(heads).combine_chunks().append_column("repaired_sha256", pa.array(hashes, pa.string()))
        return table.to_batches()[0]

    return turns.mapInArrow(run, f"conv {turns.schema['conv'].dataType.simpleString()}, {_SUMMARY}, repaired_sha256 string")
