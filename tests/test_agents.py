import pytest
from pyspark.sql import functions as F

from textguard import rules
from textguard.operators import agent_state, permissions
from textguard.operators import retrieval as ret
from textguard.operators.drift import conversation_drift, drift_alerts
from textguard.operators.sanitize import context_similarity

CALL = ("call_id int, ts timestamp_ntz, user_id string, tool_name string, operation string, "
        "permissions array<string>, reasoning_chain array<string>")


def calls(spark, rows):
    values = [(i, f"2024-01-01 00:{i:02d}:00", *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(values, CALL.replace("ts timestamp_ntz", "ts string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def decisions(spark, rows, **options):
    out = permissions.authorize(calls(spark, rows), permissions.tool_scopes(spark), **options)
    return [(r.is_allowed, r.reason) for r in out.orderBy("call_id").collect()]


OK = ["look it up", "read it", "answer"]
DENIED = (False, rules.TOOL_DENIED)


@pytest.mark.parametrize("row, expected", [
    (("u", "search_tool", "read", ["basic_access"], OK), (True, None)),
    (("u", "search_tool", "write", ["basic_access"], OK), DENIED),
    (("u", "search_tool", "read", [], OK), DENIED),
    (("u", "search_tool", "read", None, OK), DENIED),
    (("u", "search_tool", "read", ["basic_access"], []), DENIED),
    (("u", "search_tool", "read", ["basic_access"], None), DENIED),
    (("u", "search_tool", "read", ["basic_access"], ["sudo", "go"]), DENIED),
    (("u", "file_tool", "read", ["file_access"], ["sudo", "go"]), (True, None)),
    (("u", "search_tool", None, ["basic_access"], OK), DENIED),
    (("u", "admin_tool", None, ["admin_access"], OK), (True, None)),
    (("u", "rocket", "read", ["basic_access"], OK), (False, "Unknown tool: rocket")),
    (("u", None, None, None, None), (True, None)),
    (("u", "", None, None, None), (True, None)),
])
def test_single_call(spark, row, expected):
    assert decisions(spark, [row]) == [expected]


def test_cap_counts_granted_calls_only(spark):
    good, bad = ("u", "file_tool", "read", ["file_access"], OK), ("u", "file_tool", "read", [], OK)
    rows = [good, bad, *[good] * 5, bad, *[good] * 6, ("v", *good[1:]), (None, *good[1:])]
    got = [d[0] for d in decisions(spark, rows)]
    assert got == [True, False, *[True] * 5, False, *[True] * 4, False, False, True, True]
    assert got == [d[0] for d in decisions(spark, rows, rows_per_task=4)]


def test_cap_beyond_the_window_limit(spark):
    scopes = permissions.tool_scopes(spark, [("t", ["read"], [], 1.0, 1500)])
    many = spark.range(4000).select(
        F.col("id").alias("call_id"), F.timestamp_seconds("id").alias("ts"), F.lit("u").alias("user_id"), F.lit("t").alias("tool_name"),
        F.lit("read").alias("operation"), F.array().cast("array<string>").alias("permissions"), F.array(F.lit("x")).alias("reasoning_chain"))
    out = permissions.authorize(many, scopes, rows_per_task=500)
    assert out.where("is_allowed").agg(F.count("*"), F.max("call_id")).first()[:] == (1500, 1499)


def test_audit(spark):
    rows = [("u", "search_tool", "read", ["basic_access"], OK), ("u", "rocket", "read", [], OK), ("u", None, None, None, None)]
    audit = permissions.tool_audit(permissions.authorize(calls(spark, rows), permissions.tool_scopes(spark))).collect()
    assert [(a.call_id, a.success, len(a.proof_hash)) for a in audit] == [(0, True, 64)]


def test_history(spark):
    rows = [("u", "t", "r", [], ["a", "b"]), ("v", "t", "r", [], ["c"]), ("u", "t", "r", [], None), ("u", "t", "r", [], ["d"])]
    for limit in (1000, 1):
        h = permissions.reasoning_history(calls(spark, rows), rows_per_task=limit).orderBy("user_id", "step_number").collect()
        assert [(r.user_id, r.step_number, r.step) for r in h] == [("u", 1, "a"), ("u", 2, "b"), ("u", 3, "d"), ("v", 1, "c")]


def test_roles(spark):
    df = spark.createDataFrame([("reader", None), ("writer", None), ("admin", None), ("user", ["special_read"]), ("none", None)],
                               "role string, extra array<string>")
    held = [set(r[0]) for r in df.select(permissions.role_permissions(F.col("role"), F.col("extra"))).collect()]
    assert [("write" in h, "read" in h) for h in held] == [(False, True), (True, True), (True, True), (False, True), (False, False)]


@pytest.mark.parametrize("when, allowed", [
    ("2025-08-28 14:00:00", True), ("2025-08-28 02:00:00", False), ("2025-08-30 14:00:00", False), ("2025-08-28 18:00:00", False)])
def test_hours(spark, when, allowed):
    df = spark.createDataFrame([(when,)], "t string").select(permissions.within_working_hours(F.col("t").cast("timestamp")))
    assert df.first()[0] is allowed


def test_grants(spark):
    given = [("u", "special", "2025-08-28 12:00:00", "2025-08-28 13:00:00"), ("u", "special", "2025-08-28 12:30:00", "2025-08-28 15:00:00"),
             ("u", "special", "2025-09-28 10:00:00", "2025-12-28 10:00:00"), ("u", "other", "2025-08-28 13:00:00", "2025-08-28 13:00:00"),
             ("v", "other", "2025-01-01 00:00:00", "2026-01-01 00:00:00"), ("u", "late", "2025-08-28 14:00:00", "2025-08-28 15:00:00")]
    grants = spark.createDataFrame(given, "user_id string, permission string, granted_at string, expires_at string").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("granted_at", "expires_at")})
    times = ["2025-08-28 11:59:59", "2025-08-28 12:00:00", "2025-08-28 13:30:00", "2025-08-28 14:30:00", "2025-08-28 15:00:00", "2025-11-11 00:00:00"]
    asked = spark.createDataFrame([(u, t) for u in ("u", "v", "w") for t in times], "user_id string, ts string")
    asked = asked.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("permissions", F.array(F.lit("read")))
    want = [["read"], ["read", "special"], ["read", "special"], ["late", "read", "special"], ["read"], ["read", "special"]]
    want += [["other", "read"]] * 6 + [["read"]] * 6
    for rows_per_task in (5_000_000, 2):
        got = permissions.effective_permissions(asked, grants, rows_per_task=rows_per_task).orderBy("user_id", "ts").collect()
        assert [r.effective_permissions for r in got] == want
    spans = permissions.merged_grants(grants).groupBy("user_id", "permission").count().collect()
    assert {(r.user_id, r.permission): r["count"] for r in spans} == {("u", "special"): 2, ("v", "other"): 1, ("u", "late"): 1}


def test_permission_tables(spark):
    implies = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "y")], "permission string, implies string")
    roles = spark.createDataFrame([("r", "c"), ("r", "z"), ("s", "x")], "role string, permission string")
    df = spark.createDataFrame([(1, "r", ["x"]), (2, "s", None), (3, None, ["y", "y"]), (4, "t", []), (5, "r", ["x"])],
                               "i int, role string, extra array<string>")
    held = permissions.with_permissions(df, roles, implies)
    assert {r.i: r.held for r in held.collect()} == {
        1: ["a", "b", "c", "d", "e", "x", "y", "z"], 2: ["x", "y"], 3: ["y"], 4: [], 5: ["a", "b", "c", "d", "e", "x", "y", "z"]}
    assert permissions.closed({"a": ["b"], "b": ["c", "a"]}) == {"a": ["b", "c"], "b": ["c", "a"]}
    asked = held.withColumn("resource", F.when(F.col("i") < 3, "docs").otherwise("none"))
    resources = spark.createDataFrame([("docs", "z")], "resource string, permission string")
    assert {r.i: r.resource_allowed for r in permissions.with_resource_access(asked, resources).collect()} == {
        1: True, 2: False, 3: False, 4: False, 5: False}


def test_escalation_and_resources(spark):
    df = spark.createDataFrame([("user", ["admin"], "a"), ("user", ["read"], "a"), ("admin", ["read"], "system")],
                               "role string, claimed array<string>, agent string")
    assert [r[0] for r in df.select(permissions.escalation_attempt(F.col("role"), F.col("claimed"), F.col("agent"))).collect()] == [
        True, False, True]
    res = spark.createDataFrame([("public_docs", ["basic_read"]), ("private_docs", ["basic_read"]), ("x", ["basic_read"])],
                                "r string, p array<string>")
    assert [r[0] for r in res.select(permissions.resource_allowed(F.col("r"), F.col("p"))).collect()] == [True, False, False]


def test_turn_order(spark):
    df = spark.createDataFrame([("c", i, 1000 + i * 100, t) for i, t in enumerate([1, 2, 3, 2])], "k string, id int, ts int, turn int")
    out = agent_state.turn_order(df, "k", "ts", "id", "turn").orderBy("id").collect()
    assert [r.temporal_violation for r in out] == [False, False, False, True]


def test_transitions(spark):
    rows = [("c", 1, ["a", "b"], ["x"]), ("c", 2, ["a", "b", "n"], ["x"]), ("c", 3, ["a"], []), ("c", 4, ["a"], ["x"])]
    df = spark.createDataFrame(rows, "k string, id int, goals array<string>, constraints array<string>")
    out = agent_state.state_transitions(df, "k", "id", "id").orderBy("id").collect()
    assert [r.violations for r in out] == [[], [], ["invalid_state_transition", "goal_violation"], []]


def test_restore(spark):
    df = spark.createDataFrame([("c", 1, "h1"), ("c", 2, None), ("c", 3, "h3"), ("c", 4, None), ("d", 1, None)],
                               "k string, id int, h string")
    out = agent_state.restore_states(df, "k", "id", "id", "h").orderBy("k", "id").collect()
    assert [r.restored_from for r in out] == [None, "h1", None, "h3", None]


def test_drift_by_hand(spark):
    rows = [("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0]), ("u", 3, [0.0, 2.0]), ("u", 4, [-1.0, 0.0]), ("u", 5, [0.0, 0.0])]
    out = conversation_drift(spark.createDataFrame(rows, "k string, id int, embedding array<double>"), "k", "id", "id")
    got = [(r.similarity, r.drift, r.change_rate, r.max_drift, r.max_change_rate) for r in out.orderBy("id").collect()]
    assert got == [(0, 0, 0, 0, 0), (0, 1, 0, 1, 0), (1, 1, 1, 1, 1), (0, 2, 1, 2, 1), (0, 1, 0, 2, 1)]


def test_alerts_skip_trivial_turns(spark):
    rows = [("u", 1, "a long first question", [1.0, 0.0]), ("u", 2, "ok", [-1.0, 0.0]), ("u", 3, "a long second one", [-1.0, 0.1]),
            ("u", 4, "", [1.0, 0.0])]
    out = drift_alerts(spark.createDataFrame(rows, "k string, id int, t string, embedding array<double>"), "k", "id", "id", "t")
    got = {r.id: r.context_tracking for r in out.collect()}
    assert got[2].similarity == 1.0 and not got[2].is_suspicious and got[3].is_suspicious
    assert got[3].reason == "Context drift (2.00) exceeds threshold (1.50)"
    assert got[4].similarity < 0, "an empty text is no trivial turn"


def test_context_window(spark):
    rows = [("u", 0, "a b"), ("u", 299, "a b"), ("u", 600, "a b"), ("u", 601, "c"), ("u", 602, "a c")]
    df = spark.createDataFrame(rows, "k string, s int, t string").withColumn("ts", F.timestamp_seconds("s"))
    for limit in (100, 2):
        out = context_similarity(df, "k", "ts", "s", "t", rows_per_task=limit).orderBy("s").collect()
        assert [round(r.context_score, 4) for r in out] == [0.0, 1.0, 0.0, 0.0, 0.6667]


def test_retrieval(spark):
    df = spark.createDataFrame([
        ("password " * 6, 100, 60, True, 0.9, 0.9), ("find the best book", None, None, False, 0.2, 0.2), ("", 5, 0, None, None, None),
        ("x y z", 1000, 60, False, 0.5, 0.5)],
        "query string, retrieval_count int, time_window int, is_verified boolean, relevance_score double, user_trust_score double")
    got = [tuple(round(x, 3) if isinstance(x, float) else x for x in r.retrieval_analysis)
           for r in ret.retrieval_analysis(df).collect()]
    assert got == [(1.0, 1.667, 0.933, False), (0.25, 0.0, 0.133, True), (0.0, 0.0, 0.333, True), (0.333, 16.667, 0.333, False)]
