"""Queries over agent traffic: drift, tool calls, roles, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SHORT, load, picked, quoted, sql_picked, utc
from catalog.prompts import SQL_NUMBER, number
from textguard import rules
from textguard.operators import agent_state, permissions
from textguard.operators.drift import cooled_alerts, drift_alerts, drift_values, last_n

DRIFT, CHANGE = 1.1, 0.3


def vector_turns(spark, sf):
    """Embeddings as turns of 25 users, a minute apart."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.withColumn("user_id", F.pmod("vec_id", F.lit(25))).withColumn("ts", F.timestamp_seconds(F.col("vec_id") * 60))


def conversation_drift_query(spark, sf):
    d = drift_values(vector_turns(spark, sf), "user_id", "ts", "vec_id")
    return d.select("user_id", "vec_id", *[
        F.round(c, 6).alias(c) for c in ("similarity", "drift", "change_rate", "max_drift", "max_change_rate")])


def sql_drift(source, key, row_id):
    """Drift of `source` (key, row_id, v = vector as doubles), in the order of row_id."""
    return f"""
SELECT {key}, {row_id}, similarity, drift, change_rate,
       max(drift) OVER w AS max_drift, max(change_rate) OVER w AS max_change_rate
FROM (SELECT *, CASE WHEN rn >= 3 THEN abs(similarity - lag(similarity) OVER (PARTITION BY {key} ORDER BY {row_id}))
                ELSE 0.0 END AS change_rate
      FROM (SELECT {key}, {row_id}, rn, CASE WHEN rn > 1 THEN list_cosine_similarity(v, prev) ELSE 0.0 END AS similarity,
                   CASE WHEN rn > 1 THEN 1.0 - list_cosine_similarity(v, start) ELSE 0.0 END AS drift
            FROM (SELECT {key}, {row_id}, v, row_number() OVER o AS rn, lag(v) OVER o AS prev, first_value(v) OVER o AS start
                  FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY {row_id}))))
WINDOW w AS (PARTITION BY {key} ORDER BY {row_id} ROWS UNBOUNDED PRECEDING)"""


_VECTORS = "(SELECT vec_id % 25 AS user_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
CONVERSATION_DRIFT = f"""SELECT user_id, vec_id, round(similarity, 6) AS similarity, round(drift, 6) AS drift,
  round(change_rate, 6) AS change_rate, round(max_drift, 6) AS max_drift, round(max_change_rate, 6) AS max_change_rate
FROM ({sql_drift(_VECTORS, 'user_id', 'vec_id')})"""


def drift_alerts_query(spark, sf):
    """Some turns are short answers, which are no part of the sequence."""
    t = vector_turns(spark, sf).withColumn("text", picked((*SHORT, *["a longer question here"] * 15), F.col("vec_id") * 7))
    a = drift_alerts(t, "user_id", "ts", "vec_id", "text", drift_threshold=DRIFT, change_threshold=CHANGE)
    r = F.col("context_tracking")
    return a.select("user_id", "vec_id", F.round(r["drift"], 6).alias("drift"), F.round(r["similarity"], 6).alias("similarity"),
                    F.round(r["change_rate"], 6).alias("change_rate"), r["is_suspicious"].alias("is_suspicious"),
                    r["reason"].alias("reason"))


def sql_alert(drift="drift", change="change_rate", change_limit=CHANGE):
    return f"""CASE WHEN {drift} > {DRIFT} THEN 'Context drift (' || printf('%.2f', {drift}) || ') exceeds threshold ({DRIFT:.2f})'
     WHEN {change} > {change_limit} THEN 'Context change rate (' || printf('%.2f', {change}) || ') exceeds threshold ({change_limit:.2f})' END"""


_TEXTS = sql_picked((*SHORT, *["a longer question here"] * 15), "vec_id * 7")
_TRIVIAL = "length(trim(text)) <= 10 AND regexp_matches(replace(trim(text), ' ', ''), '^\\pL+$')"
SQL_TURNS = f"(SELECT *, {_TRIVIAL} AS trivial FROM (SELECT *, {_TEXTS} AS text FROM {_VECTORS}))"
DRIFT_ALERTS = f"""
SELECT user_id, vec_id, round(drift, 6) AS drift, round(similarity, 6) AS similarity, round(change_rate, 6) AS change_rate,
       {sql_alert()} IS NOT NULL AS is_suspicious, {sql_alert()} AS reason
FROM (SELECT user_id, vec_id, drift, similarity, change_rate
      FROM ({sql_drift(f"(SELECT * FROM {SQL_TURNS} WHERE NOT trivial)", 'user_id', 'vec_id')})
      UNION ALL SELECT user_id, vec_id, 0.0, 1.0, 0.0 FROM {SQL_TURNS} WHERE trivial)"""


def cooled_drift_alerts(spark, sf):
    """The alerts of `drift_alerts`, at most one per user and two hours."""
    t = vector_turns(spark, sf).withColumn("text", picked((*SHORT, *["a longer question here"] * 15), F.col("vec_id") * 7))
    tracked = drift_alerts(t, "user_id", "ts", "vec_id", "text", drift_threshold=DRIFT, change_threshold=0.15)
    return cooled_alerts(tracked, "user_id", "ts", "vec_id", 7200.0).select(
        "user_id", "vec_id", F.col("context_tracking.is_suspicious").alias("is_suspicious"),
        F.col("context_tracking.reason").alias("reason"))


_FIRST_ALERTS = f"""SELECT user_id, vec_id, {sql_alert(change_limit=0.15)} AS reason
  FROM ({sql_drift(f"(SELECT * FROM {SQL_TURNS} WHERE NOT trivial)", 'user_id', 'vec_id')})"""
COOLED_DRIFT_ALERTS = f"""
WITH RECURSIVE a AS (SELECT user_id, vec_id, row_number() OVER (PARTITION BY user_id ORDER BY vec_id) AS rn
                     FROM ({_FIRST_ALERTS}) WHERE reason IS NOT NULL),
r AS (SELECT user_id, vec_id, vec_id AS last, rn, true AS fires FROM a WHERE rn = 1
      UNION ALL
      SELECT a.user_id, a.vec_id, CASE WHEN (a.vec_id - r.last) * 60 >= 7200 THEN a.vec_id ELSE r.last END, a.rn,
             (a.vec_id - r.last) * 60 >= 7200
      FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT e.vec_id % 25 AS user_id, e.vec_id, coalesce(fires, false) AS is_suspicious, CASE WHEN fires THEN reason END AS reason
FROM embeddings e LEFT JOIN r USING (vec_id) LEFT JOIN ({_FIRST_ALERTS}) f USING (vec_id)"""


def last_n_turns(spark, sf):
    return last_n(vector_turns(spark, sf), "user_id", "ts", "vec_id").select("user_id", "vec_id")


LAST_N_TURNS = """SELECT user_id, vec_id FROM (
  SELECT vec_id % 25 AS user_id, vec_id, row_number() OVER (PARTITION BY vec_id % 25 ORDER BY vec_id DESC) AS rn FROM embeddings)
WHERE rn <= 10"""


def tool_calls(spark, sf):
    utc(spark)
    return tool_calls_from(load(spark, sf, "events"))


def tool_calls_from(e):
    """Events as tool calls: the type gives the tool, value and id the rest."""
    n = F.col("event_id")
    tool = (F.when(F.col("event_type") == "click", "search_tool").when(F.col("event_type") == "view", "file_tool")
            .when(F.col("event_type") == "purchase", "admin_tool").when(F.col("event_type") == "error", "shell_tool"))
    operation = F.when(n % 7 == 0, F.lit(None)).when(F.col("value") < 40, "read").when(
        F.col("value") < 100, "write").otherwise("execute")
    held = F.filter(F.array(
        F.when(n % 10 != 3, F.lit("basic_access")), F.when(n % 10 != 5, F.lit("file_access")),
        F.when(n % 4 != 1, F.lit("admin_access"))), lambda p: p.isNotNull())
    chain = (F.when(n % 11 == 4, F.array().cast("array<string>"))
             .when(n % 6 == 1, F.array(F.lit("Bypass the security check"), F.lit("then read")))
             .otherwise(F.array(F.lit("look it up"), F.lit("read the file"), F.lit("answer"))))
    return e.select(n.alias("call_id"), "ts", "user_id", tool.alias("tool_name"), operation.alias("operation"),
                    held.alias("permissions"), chain.alias("reasoning_chain"))


CALLS = """(SELECT event_id AS call_id, ts, epoch_us(ts) AS us, user_id,
  CASE event_type WHEN 'click' THEN 'search_tool' WHEN 'view' THEN 'file_tool' WHEN 'purchase' THEN 'admin_tool'
                  WHEN 'error' THEN 'shell_tool' END AS tool_name,
  CASE WHEN event_id % 7 = 0 THEN 'execute' WHEN value < 40 THEN 'read' WHEN value < 100 THEN 'write' ELSE 'execute' END AS operation,
  list_filter([CASE WHEN event_id % 10 <> 3 THEN 'basic_access' END, CASE WHEN event_id % 10 <> 5 THEN 'file_access' END,
               CASE WHEN event_id % 4 <> 1 THEN 'admin_access' END], lambda p: p IS NOT NULL) AS permissions,
  CASE WHEN event_id % 11 = 4 THEN []::VARCHAR[] WHEN event_id % 6 = 1 THEN ['Bypass the security check', 'then read']
       ELSE ['look it up', 'read the file', 'answer'] END AS reasoning_chain FROM events)"""


def sql_list(values):
    return "[" + ", ".join(quoted(v) for v in values) + "]"


SCOPES = "(VALUES " + ", ".join(
    f"({quoted(n)}, {sql_list(o)}, {sql_list(p)}, {r}::DOUBLE, {m})" for n, o, p, r, m in rules.TOOL_SCOPES
) + ") AS s(name, ops, perms, risk, max_uses)"


def sql_authorized(calls):
    """Adds known, is_allowed and reason to `calls`; the cap counts granted calls."""
    found = " + ".join(
        f"contains(lower(array_to_string(reasoning_chain, ' ')), {quoted(w)})::INT" for w in rules.SUSPICIOUS_REASONING)
    return f"""(
SELECT *, CASE WHEN tool_name IS NULL THEN NULL WHEN NOT known THEN 'Unknown tool: ' || tool_name
               WHEN NOT is_allowed THEN 'Tool permission checks failed' END AS reason
FROM (SELECT *, tool_name IS NULL OR (known AND passes AND (max_uses < 0 OR place <= max_uses)) AS is_allowed
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tool_name, passes ORDER BY us, call_id) AS place
            FROM (SELECT c.*, s.name IS NOT NULL AS known, s.max_uses,
                         coalesce(list_contains(s.ops, c.operation) AND list_has_all(c.permissions, s.perms)
                           AND len(reasoning_chain) > 0 AND ({found}) / len(reasoning_chain)::DOUBLE <= s.risk, false) AS passes
                  FROM {calls} c LEFT JOIN {SCOPES} ON c.tool_name = s.name))))"""


def tool_authorize(spark, sf):
    a = permissions.authorize(tool_calls(spark, sf), permissions.tool_scopes(spark))
    return a.select("call_id", "user_id", "tool_name", "operation", "is_allowed", "reason")


TOOL_AUTHORIZE = f"SELECT call_id, user_id, tool_name, operation, is_allowed, reason FROM {sql_authorized(CALLS)}"


def tool_audit(spark, sf):
    a = permissions.authorize(tool_calls(spark, sf), permissions.tool_scopes(spark))
    return permissions.tool_audit(a).select("call_id", "success", "proof_hash")


TOOL_AUDIT = f"""
SELECT call_id, is_allowed AS success, sha256(to_json({{'operation': operation, 'permissions': permissions,
  'reasoning_chain': reasoning_chain, 'success': is_allowed, 'timestamp': us, 'tool_name': tool_name,
  'user_id': user_id::VARCHAR}})::VARCHAR) AS proof_hash
FROM {sql_authorized(CALLS)} WHERE known"""


def reasoning_history(spark, sf):
    h = permissions.reasoning_history(tool_calls(spark, sf))
    return h.select("user_id", "call_id", "step_number", "step")


REASONING_HISTORY = f"""
SELECT user_id, call_id, row_number() OVER (PARTITION BY user_id ORDER BY us, call_id, i) AS step_number, reasoning_chain[i] AS step
FROM (SELECT user_id, call_id, us, reasoning_chain, unnest(range(1, len(reasoning_chain) + 1)) AS i FROM {CALLS})"""


def effective_permissions(spark, sf):
    """Purchases grant a permission for a day; every event is a call."""
    utc(spark)
    e = load(spark, sf, "events")
    grants = e.where("event_type = 'purchase'").select(
        "user_id", F.concat(F.lit("special_"), F.pmod("event_id", F.lit(3)).cast("string")).alias("permission"),
        F.col("ts").alias("granted_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    calls = e.select("event_id", "user_id", "ts", F.array(F.lit("read")).alias("permissions"))
    p = permissions.effective_permissions(calls, grants)
    return p.select("event_id", F.array_join("effective_permissions", ",").alias("effective"))


EFFECTIVE_PERMISSIONS = """
WITH g AS (SELECT user_id, 'special_' || (event_id % 3) AS permission, ts AS granted_at, ts + INTERVAL 1 DAY AS expires_at
           FROM events WHERE event_type = 'purchase')
SELECT e.event_id, array_to_string(list_sort(list_concat(['read'],
         coalesce(list(DISTINCT g.permission) FILTER (g.permission IS NOT NULL), []))), ',') AS effective
FROM events e LEFT JOIN g ON e.user_id = g.user_id AND e.ts >= g.granted_at AND e.ts < g.expires_at GROUP BY e.event_id"""


def role_access(spark, sf):
    """Role, extra permissions, resource, hours and escalation for every event."""
    utc(spark)
    e = load(spark, sf, "events")
    n = F.col("event_id")
    role = picked(("user", "reader", "writer", "admin", "guest"), F.col("user_id"))
    extra = F.when(n % 4 == 0, F.array(F.lit("advanced_read"))).when(n % 4 == 1, F.array(F.lit("system_access"))).otherwise(
        F.array().cast("array<string>"))
    claimed = F.when(n % 5 == 0, F.array(F.lit("delete"))).otherwise(F.array(F.lit("read")))
    agent = F.when(n % 17 == 0, F.lit("system")).otherwise(F.concat(F.lit("agent"), F.col("user_id").cast("string")))
    resource = picked(("public_docs", "private_docs", "system_docs", "other"), n)
    ts = F.col("ts").cast("timestamp")
    rows = e.select(
        "event_id", role.alias("role"), extra.alias("extra"), resource.alias("resource"),
        permissions.within_working_hours(ts).alias("working_hours"),
        permissions.escalation_attempt(role, claimed, agent).alias("escalation_attempt"))
    pairs = [spark.createDataFrame([(name, value) for name, values in entries.items() for value in ([values] if isinstance(values, str) else values)], schema)
             for entries, schema in ((rules.ROLE_PERMISSIONS, "role string, permission string"),
                                     (rules.IMPLIED_PERMISSIONS, "permission string, implies string"),
                                     (rules.RESOURCE_PERMISSIONS, "resource string, permission string"))]
    held = permissions.with_resource_access(permissions.with_permissions(rows, pairs[0], pairs[1]), pairs[2])
    return held.select(
        "event_id", F.array_join("held", ",").alias("permissions"), F.array_contains("held", "write").alias("may_write"),
        "working_hours", "resource_allowed", "escalation_attempt")


ROLE_ACCESS = """
WITH r AS (SELECT event_id, ts, user_id, ['user','reader','writer','admin','guest'][(user_id % 5) + 1] AS role,
             ['public_docs','private_docs','system_docs','other'][(event_id % 4) + 1] AS resource FROM events),
b AS (SELECT *, CASE role WHEN 'user' THEN ['read'] WHEN 'reader' THEN ['read','query'] WHEN 'writer' THEN ['read','write','query']
                WHEN 'admin' THEN ['read','write','delete','query'] ELSE [] END AS base FROM r),
h AS (SELECT *, list_sort(list_distinct(list_concat(base, CASE event_id % 4
                WHEN 0 THEN ['advanced_read','read','query','basic_read']
                WHEN 1 THEN ['system_access','basic_read','advanced_read','read','query'] ELSE []::VARCHAR[] END))) AS held FROM b)
SELECT event_id, array_to_string(held, ',') AS permissions, list_contains(held, 'write') AS may_write,
       isodow(ts) <= 5 AND hour(ts) >= 8 AND hour(ts) < 18 AS working_hours,
       coalesce(list_contains(held, CASE resource WHEN 'public_docs' THEN 'basic_read' WHEN 'private_docs' THEN 'advanced_read'
                                    WHEN 'system_docs' THEN 'system_access' END), false) AS resource_allowed,
       NOT list_contains(base, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'read' END) OR event_id % 17 = 0 AS escalation_attempt
FROM h"""


def agent_states(spark, sf):
    """Conversations as agent states; some turn numbers, goals and constraints are off."""
    c = load(spark, sf, "conversations")
    n = number()
    goals = F.when(n % 9 == 4, F.array(F.lit("inform"))).otherwise(F.array(F.lit("inform"), F.lit("stay safe")))
    limits = F.when(n % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("no harm")))
    return c.select("conv_id", n.alias("row_id"), F.timestamp_seconds(n).alias("ts"),
                    F.when(n % 6 == 5, F.col("turn") - 2).otherwise(F.col("turn")).alias("turn_id"),
                    goals.alias("goals"), limits.alias("constraints"), "role")


STATES = f"""(SELECT conv_id, {SQL_NUMBER} AS row_id, role,
  CASE WHEN ({SQL_NUMBER}) % 6 = 5 THEN turn - 2 ELSE turn END AS turn_id,
  CASE WHEN ({SQL_NUMBER}) % 9 = 4 THEN ['inform'] ELSE ['inform', 'stay safe'] END AS goals,
  CASE WHEN ({SQL_NUMBER}) % 7 = 3 THEN []::VARCHAR[] ELSE ['no harm'] END AS constraints FROM conversations)"""


def turn_order(spark, sf):
    return agent_state.turn_order(agent_states(spark, sf), "conv_id", "ts", "row_id", "turn_id").select(
        "conv_id", "row_id", "turn_id", "temporal_violation")


TURN_ORDER = f"""SELECT conv_id, row_id, turn_id, coalesce(turn_id <= max(turn_id) OVER (PARTITION BY conv_id ORDER BY row_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS temporal_violation FROM {STATES}"""


def state_transitions(spark, sf):
    s = agent_state.state_transitions(agent_states(spark, sf), "conv_id", "ts", "row_id")
    return s.select("conv_id", "row_id", F.array_join("violations", ",").alias("violations"))


STATE_TRANSITIONS = f"""
SELECT conv_id, row_id, coalesce(array_to_string([
  CASE WHEN len(list_filter(coalesce(pc, []), lambda x: NOT list_contains(constraints, x))) > 0 THEN 'invalid_state_transition' END,
  CASE WHEN len(list_filter(coalesce(pg, []), lambda x: NOT list_contains(goals, x))) > 0 THEN 'goal_violation' END], ','), '') AS violations
FROM (SELECT *, lag(constraints) OVER w AS pc, lag(goals) OVER w AS pg FROM {STATES} WINDOW w AS (PARTITION BY conv_id ORDER BY row_id))"""


def restore_states(spark, sf):
    s = agent_states(spark, sf).withColumn("state_hash", F.when(
        F.size("constraints") > 0, agent_state.state_hash(F.col("constraints"), F.col("goals"), F.col("role"))))
    return agent_state.restore_states(s, "conv_id", "ts", "row_id", "state_hash").select(
        "conv_id", "row_id", "state_hash", "restored_from")


RESTORE_STATES = f"""
SELECT conv_id, row_id, state_hash, CASE WHEN state_hash IS NULL THEN last_value(state_hash IGNORE NULLS) OVER (
         PARTITION BY conv_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS restored_from
FROM (SELECT *, CASE WHEN len(constraints) > 0 THEN sha256(to_json({{'constraints': constraints, 'goals': goals, 'role': role}})::VARCHAR)
             END AS state_hash FROM {STATES})"""

QUERIES = {
    "conversation_drift": (conversation_drift_query, CONVERSATION_DRIFT),
    "drift_alerts": (drift_alerts_query, DRIFT_ALERTS),
    "cooled_drift_alerts": (cooled_drift_alerts, COOLED_DRIFT_ALERTS),
    "last_n_turns": (last_n_turns, LAST_N_TURNS),
    "tool_authorize": (tool_authorize, TOOL_AUTHORIZE),
    "tool_audit": (tool_audit, TOOL_AUDIT),
    "reasoning_history": (reasoning_history, REASONING_HISTORY),
    "effective_permissions": (effective_permissions, EFFECTIVE_PERMISSIONS),
    "role_access": (role_access, ROLE_ACCESS),
    "turn_order": (turn_order, TURN_ORDER),
    "state_transitions": (state_transitions, STATE_TRANSITIONS),
    "restore_states": (restore_states, RESTORE_STATES),
}
