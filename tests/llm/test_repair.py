"""Cheapest edits against exhaustive search, tables against a plain loop over conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from textguard.llm import queries, repair
from textguard.llm.repair import Costs

GOOD = re.compile("(s?(ua)+)?")
INITIALS = "xsua"


def exhaustive(codes, costs, inserts=2):
    """Least (cost, letters) over all edits with at most `inserts` Inserts at each border, by trying all."""
    at_border = [""] + ["".join(p) for n in range(1, inserts + 1) for p in product("ua", repeat=n)]
    per_turn = []
    for code in codes:
        fault, extra = code >> 2, costs.truncated if code >> 2 == 3 else 0
        options = [(costs.delete, "D", "")]
        if fault not in (1, 2):
            options += [(costs.rerole + extra, "R", "u"), (costs.rerole + extra, "R", "a"), (extra, "K", INITIALS[code & 3])]
        per_turn.append(options)
    best = None
    for edits in product(*per_turn):
        for borders in product(at_border, repeat=len(codes) + 1):
            out, audit, cost = borders[0], "I" * len(borders[0]), costs.insert * sum(map(len, borders))
            for (c, letter, gives), more in zip(edits, borders[1:], strict=True):
                out, audit, cost = out + gives + more, audit + letter + "I" * len(more), cost + c
            if GOOD.fullmatch(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def plain(codes, costs):
    """Least (cost, letters) by a memo over turns and states, with letters as strings; for long conversations."""
    def with_inserts(paths):
        out = dict(paths)
        for _ in range(3):
            out = {q: min(paths.get(q, (10**9, "")), (out.get(n, (10**9, ""))[0] + costs.insert, "I" + out.get(n, (0, ""))[1]))
                   for q, n in ((0, 2), (1, 2), (2, 3), (3, 2))}
        return out
    paths = with_inserts({0: (0, ""), 3: (0, "")})
    for code in reversed(codes):
        initial, fault = INITIALS[code & 3], code >> 2
        extra, ahead = costs.truncated if fault == 3 else 0, {}
        for q in range(4):
            options = [(paths[q][0] + costs.delete, "D" + paths[q][1])]
            if fault not in (1, 2):
                to = 3 if q == 2 else 2
                options.append((paths[to][0] + costs.rerole + extra, "R" + paths[to][1]))
                kept = {(0, "s"): 1, (2, "a"): 3}.get((q, initial), 2 if initial == "u" and q != 2 else None)
                if kept:
                    options.append((paths[kept][0] + extra, "K" + paths[kept][1]))
            ahead[q] = min(options)
        paths = with_inserts(ahead)
    return paths[0]


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(insert=2, delete=3), Costs(rerole=4, insert=4), Costs(rerole=9, delete=4, insert=1, truncated=0)])
def test_exhaustive(costs):
    rng = random.Random(1)
    for n in range(4):
        for _ in range((1, 20, 30, 6)[n]):
            codes = bytes(rng.randint(0, 3) + 4 * rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n))
            assert repair.cheapest(codes, costs) == exhaustive(codes, costs) == plain(codes, costs), list(codes)


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_blocks(block):
    rng = random.Random(block)
    for costs in (Costs(), Costs(rerole=3), Costs(truncated=1, rerole=0), Costs(insert=3)):
        for n in (1, 2, 5, 40, 300):
            for _ in range(10):
                codes = bytes(rng.choice((2, 3, 2, 3, 1, 0)) + 4 * rng.choice((0, 0, 0, 0, 1, 2, 3)) for _ in range(n))
                assert repair.cheapest(codes, costs, block) == plain(codes, costs)


def test_long_conversation():
    rng = random.Random(9)
    codes = bytes(rng.choice((2, 3, 2, 3, 1, 0)) + 4 * rng.choice((0, 0, 0, 0, 1, 2, 3)) for _ in range(200_000))
    cost, audit = repair.cheapest(codes)
    assert len(audit) == len(codes) and "I" not in audit
    state, total = 0, 0
    for code, letter in zip(codes, audit, strict=True):
        state = repair.step(state, letter, code & 3)
        assert state is not None and (letter == "D" or code >> 2 not in (1, 2))
        total += {"K": 0, "R": 1, "D": 2}[letter] + 5 * (letter != "D" and code >> 2 == 3)
    assert state in (0, 3) and total == cost


def expected(rows):
    """op12's rows from (conv_id, turn, role, text) by a loop."""
    def s(x):
        return " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = s(role), s(text)
        h = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        own = convs[conv]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, count = set(), [], [0, 0, 0, 0]
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            count[fault] += 1
            codes.append((INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 0) + 4 * fault)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit = plain(codes, Costs())
        done, state, at = [], 0, 0
        for letter in audit:
            if letter == "I":
                raise AssertionError("an Insert never pays")
            _, role, text = own[at]
            at += 1
            if letter != "D":
                state = 1 if letter == "K" and role[0] == "s" else 3 if state == 2 else 2
                done.append((role if letter == "K" else ("assistant" if state == 3 else "user")) + ":" + text)
        assert GOOD.fullmatch("".join(x[0] for x in done))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count[1:], illegal, cost, audit,
                     hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r[f] for f in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = queries.op12_repair(spark, folder)
    want = expected(rows)
    assert got(df) == want and df.count() == len(want)
    assert {len(w[6]) > 0 for w in want.values()} == {True, False} or len(want) > 50


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    some = ["", " ", None, "ok.", "ok.", "open", "a! \n", "b?\t", "é.", "x\x85", ". ", "So: it"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(some))
            for _ in range(600)]
    rows += [(99, t, ("user", "assistant")[t % 2], "x" * 200_000 + ".") for t in range(4)]
    rows += [(500, t, ("user", "assistant", "user")[t % 3], f"turn {t}.") for t in range(12_000)]  # more than one Arrow batch
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, conv string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(queries.op12_repair(spark, str(tmp_path))) == expected(rows)
    (empty := tmp_path / "empty").mkdir()
    df.where("false").write.parquet(str(empty / "conversations.parquet"))
    assert queries.op12_repair(spark, str(empty)).collect() == []


def test_inserted_turns(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "x."), (2, 0, "user", "y."), (3, 0, "system", "z.")]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    names = {"conv": "c", "turn": "t", "role": "r", "text": "x"}
    found = repair.repaired(df, repair.assess(df, costs=Costs(rerole=3, insert=1), **names), **names).where("place > 0")
    assert sorted((r.conv, r.place, r.role, r.text, r.edit) for r in found.collect()) == [
        (1, 1, "user", "", "I"), (1, 2, "assistant", "hello.", "K"), (1, 3, "user", "x.", "K"), (1, 4, "assistant", "", "I"),
        (2, 1, "user", "y.", "K"), (2, 2, "assistant", "", "I")]  # the lone system turn: D comes before KII, at the same cost
