"""Tool calls: scopes, usage caps, audit; roles, resources, hours and grants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard import rules
from textguard.durable import durable
from textguard.operators.drift import first_n
from textguard.operators.ordered import ROWS_PER_TASK, Ordered


def tool_scopes(spark: SparkSession, scopes: Sequence[tuple] = rules.TOOL_SCOPES) -> DataFrame:
    return spark.createDataFrame(
        list(scopes), "tool_name string, allowed_operations array<string>, "
        "required_permissions array<string>, tool_risk double, max_uses int")


def reasoning_suspicion(chain: Column) -> Column:
    """Suspicious words present in the chain of reasoning, per step; null for an
    empty chain."""
    joined = F.lower(F.array_join(chain, " "))
    found = sum((joined.contains(w).cast("int") for w in rules.SUSPICIOUS_REASONING), F.lit(0))
    return F.when(F.size(chain) > 0, found / F.size(chain))


def _checked(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """Calls with their scope and the checks that look at one call only."""
    known = scopes.withColumn("_known", F.lit(True))
    operation = F.coalesce(F.col("operation"), F.lit(rules.DEFAULT_OPERATION))
    held = F.coalesce(F.col("permissions"), F.array().cast("array<string>"))
    uses_tool = F.coalesce(F.col("tool_name") != "", F.lit(False))
    passes = (
        F.array_contains("allowed_operations", F.col("operation"))
        & (F.size(F.array_except("required_permissions", F.col("permissions"))) == 0)
        & F.coalesce(reasoning_suspicion(F.col("reasoning_chain")) <= F.col("tool_risk"), F.lit(False)))
    return (
        calls.withColumn("operation", operation).withColumn("permissions", held)
        .join(known, "tool_name", "left")
        .withColumn("_uses_tool", uses_tool)
        .withColumn("_known", F.coalesce(F.col("_known"), F.lit(False)))
        .withColumn("_passes", F.col("_uses_tool") & F.col("_known") & passes))


def passing_calls(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """Tool calls that pass every check but the usage cap, with their `max_uses`."""
    return _checked(calls, scopes).where("_passes").select(*calls.columns, "max_uses")


def authorize(calls: DataFrame, scopes: DataFrame, user: str = "user_id", ts: str = "ts",
              row_id: str = "call_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `is_allowed` and `reason` to each call, plus `tool_known`.

    A call without a tool is allowed, one with an unknown tool is denied.  The
    usage cap grants the first `max_uses` calls of a user and tool that pass all
    other checks: denied calls never count, so no state is needed.  Only these
    first calls matter, hence each user and tool comes down to the place of its
    last granted call, and no group of calls is ever gathered.
    """
    checked = _checked(calls, scopes)
    capped = checked.where(F.col("_passes") & (F.col("max_uses") >= 0)).select(
        user, "tool_name", ts, row_id, "max_uses")
    largest = scopes.agg(F.max("max_uses")).first()[0]
    granted = first_n(capped, [user, "tool_name"], [ts, row_id], max(largest or 0, 0), rows_per_task).where(
        F.col("rank") <= F.col("max_uses"))
    last = granted.groupBy(F.col(user).alias("_user"), F.col("tool_name").alias("_tool")).agg(
        F.max(F.struct(ts, row_id)).alias("_last"))
    joined = checked.join(
        last, F.col(user).eqNullSafe(F.col("_user")) & (F.col("tool_name") == F.col("_tool")), "left")
    within = (F.col("max_uses") < 0) | F.coalesce(F.struct(ts, row_id) <= F.col("_last"), F.lit(False))
    allowed = ~F.col("_uses_tool") | (F.col("_passes") & within)
    reason = (
        F.when(F.col("_uses_tool") & ~F.col("_known"), F.concat(F.lit(rules.UNKNOWN_TOOL), F.col("tool_name")))
        .when(~F.col("is_allowed"), F.lit(rules.TOOL_DENIED)))
    return (
        joined.withColumn("is_allowed", F.coalesce(allowed, F.lit(False)))
        .withColumn("reason", reason)
        .withColumn("tool_known", F.col("_known") & F.col("_uses_tool"))
        .drop("_user", "_tool", "_last", "_known", "_passes", "_uses_tool",
              *[c for c in scopes.columns if c != "tool_name"]))


def proof_hash(ts: Column, user: Column) -> Column:
    """Hash of an audit entry's JSON, its keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(
        F.col("operation"), F.col("permissions"), F.col("reasoning_chain"),
        F.col("is_allowed").alias("success"), F.unix_micros(ts.cast("timestamp")).alias("timestamp"),
        F.col("tool_name"), user.cast("string").alias("user_id"))), 256)


def tool_audit(authorized: DataFrame, user: str = "user_id", ts: str = "ts",
               row_id: str = "call_id") -> DataFrame:
    """Audit entries for authorised calls; unknown tools leave none."""
    return authorized.where("tool_known").select(
        row_id, F.col(ts).alias("timestamp"), F.col(user).alias("user_id"), "tool_name", "operation",
        "permissions", "reasoning_chain", F.col("is_allowed").alias("success"),
        proof_hash(F.col(ts), F.col(user)).alias("proof_hash"))


def reasoning_history(calls: DataFrame, user: str = "user_id", ts: str = "ts", row_id: str = "call_id",
                      rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A user's reasoning steps as rows, numbered through in order of time.

    The history known at a call is the user's rows up to the call's last number;
    as rows it stays linear in the steps, as arrays it would grow with their
    square."""
    sized = calls.withColumn("_steps", F.size(F.coalesce(
        F.col("reasoning_chain"), F.array().cast("array<string>"))))
    offset = Ordered(sized.where(F.col("_steps") > 0), [user], [ts, row_id], rows_per_task).running(
        {"_before": ("sum", F.col("_steps"))}, inclusive=False)
    return offset.rows().select(
        user, ts, row_id, "_before", F.posexplode("reasoning_chain").alias("_i", "step")).select(
        user, ts, row_id, (F.col("_before") + F.col("_i") + 1).cast("bigint").alias("step_number"), "step")


def _map_literal(entries: Mapping[str, Sequence[str]]) -> Column:
    pairs = []
    for name, values in entries.items():
        pairs += [F.lit(name), F.array(*[F.lit(v) for v in values])]
    return F.create_map(*pairs)


def closed(implications: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """What each permission implies, directly or through others."""
    out = {}
    for name in implications:
        seen, todo = [], list(implications[name])
        while todo:
            other = todo.pop(0)
            if other != name and other not in seen:
                seen.append(other)
                todo += implications.get(other, ())
        out[name] = seen
    return out


def implication_closure(implications: DataFrame, max_steps: int = 64) -> DataFrame:
    """All pairs (permission, implies) of a table of such pairs, through any number of steps;
    each step doubles the length of the chains that are covered."""
    pairs = durable(implications.select("permission", "implies").distinct())
    for _ in range(max_steps):
        onward = pairs.select(F.col("permission").alias("implies"), F.col("implies").alias("_further"))
        longer = pairs.join(onward, "implies").select("permission", F.col("_further").alias("implies"))
        wider = durable(pairs.unionByName(longer).distinct())
        if wider.count() == pairs.count():
            return pairs
        pairs = wider
    raise ValueError(f"chains of implications of more than 2**{max_steps} steps")


def with_permissions(df: DataFrame, roles: DataFrame, implications: DataFrame, role: str = "role",
                     extra: str = "extra", result: str = "held") -> DataFrame:
    """Add the sorted permissions of a role (table role, permission) and an array of extra ones,
    with all that they imply (table permission, implies).

    The tables meet each combination of role and extra permissions once; rows are
    joined with their combination."""
    none = F.array().cast("array<string>")
    kinds = df.select(F.col(role).alias("_role"), F.array_sort(F.array_distinct(F.coalesce(F.col(extra), none))).alias("_extra"))
    kinds = durable(kinds.distinct())
    given = kinds.join(roles.select(F.col("role").alias("_role"), "permission"), "_role").select("_role", "_extra", "permission")
    given = given.unionByName(kinds.select("_role", "_extra", F.explode("_extra").alias("permission")))
    further = given.join(implication_closure(implications), "permission").select("_role", "_extra", F.col("implies").alias("permission"))
    held = given.unionByName(further).groupBy("_role", "_extra").agg(F.array_sort(F.collect_set("permission")).alias(result))
    rows = df.withColumn("_extra", F.array_sort(F.array_distinct(F.coalesce(F.col(extra), none))))
    held = held.withColumnRenamed("_extra", "_given")
    joined = rows.join(held, F.col(role).eqNullSafe(F.col("_role")) & (F.col("_extra") == F.col("_given")), "left")
    return joined.withColumn(result, F.coalesce(result, none)).drop("_role", "_extra", "_given")


def with_resource_access(df: DataFrame, resources: DataFrame, resource: str = "resource", held: str = "held",
                         result: str = "resource_allowed") -> DataFrame:
    """Add whether the permission that a resource asks for (table resource, permission) is held;
    unknown resources are refused."""
    asked = resources.select(F.col("resource").alias("_resource"), F.col("permission").alias("_asked"))
    joined = df.join(asked, F.col(resource) == F.col("_resource"), "left")
    return joined.withColumn(result, F.coalesce(F.array_contains(held, F.col("_asked")), F.lit(False))).drop("_resource", "_asked")


def implied(permissions: Column, implications: Mapping[str, Sequence[str]] = rules.IMPLIED_PERMISSIONS) -> Column:
    """Permissions with all that they imply, in however many steps."""
    none = F.array().cast("array<string>")
    lookup = _map_literal(closed(implications))
    added = F.flatten(F.transform(permissions, lambda p: F.coalesce(F.element_at(lookup, p), none)))
    return F.array_distinct(F.concat(permissions, added))


def role_permissions(role: Column, extra: Column,
                     roles: Mapping[str, Sequence[str]] = rules.ROLE_PERMISSIONS) -> Column:
    """What a role and extra permissions allow together, implications included."""
    none = F.array().cast("array<string>")
    base = F.coalesce(F.element_at(_map_literal(roles), role), none)
    return implied(F.array_distinct(F.concat(base, F.coalesce(extra, none))))


def within_working_hours(ts: Column, hours: tuple[int, int] = rules.WORKING_HOURS) -> Column:
    """Monday to Friday, from the first hour up to but without the last."""
    return F.dayofweek(ts).between(2, 6) & (F.hour(ts) >= hours[0]) & (F.hour(ts) < hours[1])


def resource_allowed(resource: Column, permissions: Column,
                     required: Mapping[str, str] = rules.RESOURCE_PERMISSIONS) -> Column:
    """Whether the permission a resource asks for is among those held; unknown
    resources are refused."""
    pairs = [F.lit(x) for pair in required.items() for x in pair]
    return F.coalesce(F.array_contains(permissions, F.element_at(F.create_map(*pairs), resource)), F.lit(False))


def escalation_attempt(role: Column, claimed: Column, agent: Column) -> Column:
    """Claims beyond the role, or an agent posing as the system."""
    beyond = F.size(F.array_except(claimed, role_permissions(role, F.lit(None).cast("array<string>")))) > 0
    return F.coalesce(beyond, F.lit(False)) | F.coalesce(agent.isin(*rules.SYSTEM_AGENTS), F.lit(False))


def merged_grants(grants: DataFrame, user: str = "user_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Grants (granted_at, expires_at) that overlap or touch as one, per user and permission."""
    keys = [user, "permission"]
    grants = grants.select(*keys, "granted_at", "expires_at").where("granted_at < expires_at")
    order = ["granted_at", "expires_at"]
    known = Ordered(grants, keys, order, rows_per_task).running({"_until": ("max", F.col("expires_at"))}, inclusive=False).rows()
    fresh = known.withColumn("_new", F.coalesce(F.col("granted_at") > F.col("_until"), F.lit(True)).cast("long"))
    numbered = Ordered(fresh, keys, order, rows_per_task).running({"_span": ("sum", F.col("_new"))}).rows()
    return numbered.groupBy(*keys, "_span").agg(
        F.min("granted_at").alias("granted_at"), F.max("expires_at").alias("expires_at")).drop("_span")


def effective_permissions(calls: DataFrame, grants: DataFrame, user: str = "user_id", ts: str = "ts",
                          bucket_days: int = 30, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `effective_permissions`: those held plus the user's grants in force, from
    `granted_at` up to but without `expires_at`.

    Grants are merged per user and permission and laid out by spans of
    `bucket_days`; a call meets one row, its user's grants in its span, so calls
    are never multiplied by grants and a user's row stays short."""
    def bucket(time: Column) -> Column:
        return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(bucket_days * 86_400_000_000))

    last = bucket(F.col("expires_at"))
    laid = merged_grants(grants, user, rows_per_task).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("granted_at")), last)))
    per_user = laid.groupBy(user, "_bucket").agg(F.collect_list(F.struct("permission", "granted_at", "expires_at")).alias("_grants"))
    none = F.array().cast("array<string>")
    valid = F.transform(F.filter("_grants", lambda g: (F.col(ts) >= g["granted_at"]) & (F.col(ts) < g["expires_at"])),
                        lambda g: g["permission"])
    return calls.withColumn("_bucket", bucket(F.col(ts))).join(per_user, [user, "_bucket"], "left").withColumn(
        "effective_permissions", F.array_sort(F.array_union(
            F.coalesce(F.col("permissions"), none), F.coalesce(valid, none)))).drop("_grants", "_bucket")
