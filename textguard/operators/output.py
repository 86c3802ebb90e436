"""Answers of a model: redaction, policy, safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard import rules
from textguard.functions import pii, policy
from textguard.functions import text as tx


def filter_text(df: DataFrame, text: str = "text", toxicity: Column | None = None,
                entities: Column | None = None) -> DataFrame:
    """Add `filter_result`; unsafe texts are replaced in `text`, safe ones stay.

    `filter_result.filtered_text` is what the caller gets: the refusal, or the
    text with personal data (and `entities`, spans of a gazetteer) redacted."""
    toxic = F.lit(0.0) if toxicity is None else F.coalesce(toxicity, F.lit(0.0))
    checked = (
        df.withColumn("_pii", pii.pii_spans(F.col(text)))
        .withColumn("_spans", F.col("_pii") if entities is None else F.concat("_pii", entities))
        .withColumn("_violations", policy.violations(F.col(text)))
        .withColumn("_toxicity", toxic)
        .withColumn("_safe", policy.is_safe_output(F.col("_violations"), F.col("_toxicity"))))
    redacted = pii.redact_pii(F.col(text)) if entities is None else pii.redact_spans(F.col(text), F.col("_spans"))
    filtered = F.when(F.col("_safe"), F.when(F.size("_spans") > 0, redacted).otherwise(F.col(text))).otherwise(
        F.lit(rules.HARM_REFUSAL))
    result = F.struct(
        F.col("_safe").alias("is_safe"), filtered.alias("filtered_text"), F.col("_spans").alias("detected_entities"),
        F.col("_violations").alias("policy_violations"), F.col("_toxicity").alias("toxicity_score"),
        policy.confidence(F.col("_spans"), F.col("_violations"), F.col("_toxicity")).alias("confidence"))
    return (
        checked.withColumn("filter_result", result)
        .withColumn(text, F.when(F.col("_safe"), F.col(text)).otherwise(F.lit(rules.HARM_REFUSAL)))
        .drop("_pii", "_spans", "_violations", "_toxicity", "_safe"))


def dictionary_keywords(df: DataFrame, row_id: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Whole-word matches against a keyword table (`keyword`, `list`) of any
    size: `row_id, list, keywords`, the keywords sorted.

    Each text's words are made distinct where they are, so a word shuffles once
    per text; what is gathered is at most a text's own vocabulary."""
    words = df.select(row_id, F.explode_outer(F.array_distinct(tx.words(F.col(text)))).alias("keyword"))
    names = dictionary.select("keyword", "list").distinct()
    return (words.where("keyword is not null").join(names, "keyword").groupBy(row_id, "list")
            .agg(F.array_sort(F.collect_list("keyword")).alias("keywords")))
