"""Prompts: cleaning, layer scores, injection score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import injection as inj
from textguard.functions import text as tx
from textguard.functions import vectors as vec
from textguard.operators.ordered import ROWS_PER_TASK, Ordered, micros


def context_scores(df: DataFrame, key: str, ts: str, row_id: str, text: str,
                   seconds: int = rules.CONTEXT_SECONDS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`key, ts, row_id, context_score`: the word overlap (Jaccard) with the key's last three texts, as
    far as they lie within `seconds` before the row; 0 if there are none.

    Words go through the window as 64-bit hashes, sorted; texts stay where they are."""
    def add(rows: DataFrame, window) -> DataFrame:
        recent = []
        for i in range(1, rules.CONTEXT_TEXTS + 1):
            age = F.col("_micros") - F.lag("_micros", i).over(window)
            recent.append(F.when(age < seconds * 1_000_000, F.lag("_words", i).over(window)))
        return rows.withColumn("_recent", F.flatten(F.array_compact(F.array(*recent))))

    hashes = F.sort_array(F.array_distinct(F.transform(tx.words(F.col(text)), lambda w: F.xxhash64(w))))
    named = list(dict.fromkeys([key, ts, row_id]))  # time and id may be one column
    rows = df.select(*named, micros(df, ts).alias("_micros"), hashes.alias("_words"))
    found = Ordered(rows, [key], [ts, row_id], rows_per_task).look_back(rules.CONTEXT_TEXTS, add).rows()
    score = F.when(F.size("_recent") > 0, tx.jaccard(F.col("_words"), F.col("_recent"))).otherwise(0.0)
    return found.select(*named, F.coalesce(score, F.lit(0.0)).alias("context_score"))


def context_similarity(df: DataFrame, key: str, ts: str, row_id: str, text: str,
                       seconds: int = rules.CONTEXT_SECONDS, result: str = "context_score",
                       rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `context_scores`, joined back by `row_id`, which must be unique."""
    scores = context_scores(df, key, ts, row_id, text, seconds, rows_per_task)
    return df.join(scores.select(F.col(row_id).alias("_id"), F.col("context_score").alias(result)), F.col(row_id) == F.col("_id"), "left").drop("_id")


def sanitize(df: DataFrame, prompt: str = "prompt", context_score: Column | None = None,
             embedding: Column | None = None, mean: Column | None = None,
             rate_allowed: Column | None = None, model: tuple[str, str] | None = None) -> DataFrame:
    """Rewrite the prompt in its cleaned form and add `sanitization_result`.

    Optional inputs: the overlap with recent texts (layer 2), an embedding and
    its mean (layer 3), the rate limiter's decision, and the names of a
    classifier's label and confidence columns.  Works on streams as well, since
    it looks at one row at a time.
    """
    layer2 = F.lit(0.0) if context_score is None else F.coalesce(context_score, F.lit(0.0))
    layer3 = F.lit(None).cast("double") if embedding is None else vec.layer3_score(
        embedding, mean, rules.LAYER3_SCALE, rules.LAYER3_CAP)
    allowed = F.lit(True) if rate_allowed is None else F.coalesce(rate_allowed, F.lit(True))
    trivial = F.col("_trivial")
    layered = (
        df.withColumn("_nfkc", tx.nfkc(F.col(prompt)))
        .withColumn("_trivial", tx.is_trivial_prompt(F.col("_nfkc")))
        .withColumn("_l1", F.when(trivial, 0.0).otherwise(tx.char_class_score(F.col("_nfkc"))))
        .withColumn("_l2", F.when(trivial, 0.0).otherwise(layer2))
        .withColumn("_l3", F.when(trivial, 0.0).otherwise(layer3))
        .withColumn(prompt, tx.clean(F.col("_nfkc")))
    )
    scored = inj.injection_score(layered, prompt)
    if model is not None:
        scored = inj.add_model_score(scored, *model)
    reason = (
        F.when(~allowed, F.lit(rules.RATE_LIMIT_ERROR))
        .when(F.col("is_injection"), inj.injection_reason(F.col("injection_score"), F.col("matched_categories"))))
    layers = F.array(*[
        F.struct(F.lit(i).alias("layer"), F.col(f"_l{i}").alias("score")) for i in (1, 2, 3)])
    result = F.struct(
        (allowed & ~F.col("is_injection")).alias("is_safe"),
        tx.exit_probability(F.col("_l1"), F.col("_l2"), F.col("_l3")).alias("exit_probability"),
        layers.alias("layer_scores"),
        F.col("_l3").alias("mahalanobis_score"),
        F.col(prompt).alias("sanitized_text"),
        F.col("injection_score"),
        F.col("matched_categories"),
        reason.alias("reason"),
    )
    return scored.withColumn("sanitization_result", result).drop(
        "_nfkc", "_trivial", "_l1", "_l2", "_l3", "injection_score", "matched_categories", "is_injection")
