"""The gate: all phases over a table of requests, with one verdict each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.durable import durable
from textguard.functions.pii import SPAN
from textguard.operators.classifier import Model, classify
from textguard.operators.drift import drift_alerts
from textguard.operators.output import filter_text
from textguard.operators.ordered import ROWS_PER_TASK
from textguard.operators.permissions import authorize
from textguard.operators.ratelimit import Limits, rate_limit
from textguard.operators.sanitize import context_scores, sanitize


def verdict(df: DataFrame, failures: dict[str, Column], results: dict[str, str]) -> DataFrame:
    """Add `reason`, `is_blocked` and the final `response`.

    `failures` says, phase by phase in order, when a row fails; the first
    failure gives the reason.  `results` names the result column of a phase:
    results of phases after the failure become null, as those never ran."""
    out = df
    passed = F.lit(True)
    reason = F.lit(None).cast("string")
    for phase, fails in failures.items():
        failed = F.coalesce(fails, F.lit(False))
        if phase in results:
            out = out.withColumn(f"_keep_{phase}", passed)
        reason = F.coalesce(reason, F.when(failed, F.lit(rules.GATE_REASONS[phase])))
        passed = passed & ~failed
    out = out.withColumn("reason", reason).withColumn("is_blocked", F.col("reason").isNotNull())
    for phase, column in results.items():
        out = out.withColumn(column, F.when(F.col(f"_keep_{phase}"), F.col(column))).drop(f"_keep_{phase}")
    return out


def gate(requests: DataFrame, scopes: DataFrame, limits: Limits = rules.RATE_LIMITS,
         drift_threshold: float = rules.DRIFT_THRESHOLD,
         change_threshold: float = rules.CHANGE_RATE_THRESHOLD,
         rows_per_task: int = ROWS_PER_TASK, model: Model | None = None,
         entities: Callable[[Column], Column] | None = None, context_seconds: int | None = None,
         mean: Column | None = None) -> DataFrame:
    """Sanitize, authorise, track, (retrieval, integrity,) filter; first failure
    decides.

    `requests`: request_id, ts, user_id, prompt, embedding, answer (the model's
    response), and optionally tool_name, operation, reasoning_chain,
    permissions, toxicity_score, model_label and model_score (a classifier's verdict on
    the prompt), and the struct columns `retrieval_analysis` (is_safe) and
    `integrity_check` (is_valid), which switch those phases on.

    `model` is a classifier that is run over the whole prompts where the requests bring no
    verdict of one; `entities` finds names to redact in answers
    (`entities.entity_finder`); `context_seconds` compares prompts with the user's last
    three (layer 2); `mean` is what embeddings are measured from (layer 3).

    Texts are looked at in one pass and written out.  The phases that keep state
    per user then work on narrow rows, and only on those that passed so far:
    a blocked prompt neither uses up a tool nor counts as a turn.
    """
    toxicity = F.col("toxicity_score") if "toxicity_score" in requests.columns else None
    raw = requests.withColumn("raw_prompt", F.col("prompt"))
    if model is not None and "model_label" not in requests.columns:
        raw = classify(raw, "request_id", "prompt", model)
    verdicts = ("model_label", "model_score") if "model_label" in raw.columns else None
    if context_seconds is not None:
        overlap = context_scores(requests, "user_id", "ts", "request_id", "prompt", context_seconds, rows_per_task)
        raw = raw.join(overlap.select("request_id", F.col("context_score").alias("_overlap")), "request_id", "left")
    texts = sanitize(raw, context_score=F.col("_overlap") if context_seconds is not None else None,
                     embedding=F.col("embedding"), mean=mean, model=verdicts)
    found = None if entities is None else F.coalesce(entities(F.col("answer")), F.array().cast(f"array<{SPAN}>"))
    screened = durable(filter_text(texts, "answer", toxicity, found).drop("answer", "_overlap"))

    narrow = screened.select("request_id", "ts", "user_id")
    limited = rate_limit(narrow, "user_id", "ts", "request_id", limits, rows_per_task).select(
        "request_id", F.col("allowed").alias("_within_limit"))
    tool_columns = {"tool_name": "string", "operation": "string", "reasoning_chain": "array<string>",
                    "permissions": "array<string>"}
    calls = (
        screened.where("sanitization_result.is_safe")
        .select("request_id", "ts", "user_id", "prompt", "embedding", *[
            F.col(c) if c in requests.columns else F.lit(None).cast(kind).alias(c)
            for c, kind in tool_columns.items()])
        .join(limited.where("_within_limit"), "request_id"))
    checked = durable(authorize(calls, scopes, row_id="request_id", rows_per_task=rows_per_task))
    enforcement = checked.select("request_id", F.struct(
        "is_allowed", "permissions", "reason").alias("enforcement_result"))
    tracking = drift_alerts(
        checked.where("is_allowed").select("request_id", "ts", "user_id", "prompt", "embedding"),
        "user_id", "ts", "request_id", "prompt", "embedding", drift_threshold, change_threshold,
        rows_per_task).select("request_id", "context_tracking")

    # Narrow verdicts meet first; the wide rows are shuffled once.
    narrow_results = limited.join(enforcement, "request_id", "left").join(tracking, "request_id", "left")
    joined = screened.join(narrow_results, "request_id", "left")
    within = F.coalesce(F.col("_within_limit"), F.lit(False))
    # A request beyond its limit is turned away before anyone looks at its text.
    unchecked = F.struct(*[
        F.lit(False).alias(f.name) if f.name == "is_safe"
        else F.lit(rules.RATE_LIMIT_ERROR).alias(f.name) if f.name == "reason"
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in screened.schema["sanitization_result"].dataType.fields])
    joined = joined.withColumn(
        "sanitization_result", F.when(within, F.col("sanitization_result")).otherwise(unchecked))
    failures = {
        "sanitize": ~F.col("sanitization_result.is_safe"),
        "permission": ~F.col("enforcement_result.is_allowed"),
        "context": F.col("context_tracking.is_suspicious"),
    }
    results = {"permission": "enforcement_result", "context": "context_tracking"}
    if "retrieval_analysis" in requests.columns:
        failures["retrieval"] = ~F.col("retrieval_analysis.is_safe")
        results["retrieval"] = "retrieval_analysis"
    if "integrity_check" in requests.columns:
        failures["integrity"] = ~F.col("integrity_check.is_valid")
        results["integrity"] = "integrity_check"
    failures["output"] = ~F.col("filter_result.is_safe")
    results["output"] = "filter_result"
    decided = verdict(joined, failures, results)
    return decided.withColumn("response", F.when(F.col("is_blocked"), F.lit(rules.REFUSAL)).otherwise(
        F.col("filter_result.filtered_text"))).drop("_within_limit")
