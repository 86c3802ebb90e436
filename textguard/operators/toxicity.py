"""A toxicity score from labelled texts, for tables that bring none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[ \\t\\n\\r]+"), lambda w: w != ""))


def word_weights(labelled: DataFrame, text: str = "text", label: str = "label", min_texts: int = 3) -> DataFrame:
    """word, weight: how much a word's presence speaks for class 1, as the difference of the
    logarithms of its smoothed shares in the two classes; words of fewer than `min_texts` texts are left out.
    The row with a null word has the classes' own odds."""
    texts = labelled.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("long").alias("y"))
    t1, t0 = texts.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    words = texts.select(F.explode(F.concat(_distinct_words(F.col("text")), F.array(F.lit(None).cast("string")))).alias("word"), "y")
    counts = words.groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    share = F.log((F.col("n1") + 1) / (t1 + 2)) - F.log((F.col("n0") + 1) / (t0 + 2))
    prior = F.log(F.lit((t1 + 1) / (t0 + 1)))
    return counts.where(F.col("word").isNull() | (F.col("n1") + F.col("n0") >= min_texts)).select(
        "word", F.when(F.col("word").isNull(), prior).otherwise(share).alias("weight"))


def word_odds_score(df: DataFrame, weights: DataFrame, row_id: str, text: str = "text") -> DataFrame:
    """`row_id`, `toxicity_score`: the probability of class 1 by the weights of the text's distinct
    words; 0 for missing texts. Words are joined, one weight each; frequent ones are
    split by adaptive execution."""
    words = df.select(row_id, F.explode(F.concat(_distinct_words(F.coalesce(F.col(text), F.lit(""))), F.array(F.lit("")))).alias("word"))
    named = weights.select(F.coalesce("word", F.lit("")).alias("word"), "weight")
    odds = words.join(named, "word").groupBy(row_id).agg(F.sum("weight").alias("_odds"))
    return df.select(row_id, F.col(text).isNull().alias("_missing")).join(odds, row_id, "left").select(
        row_id, F.when(F.col("_missing"), 0.0).otherwise(1 / (1 + F.exp(-F.coalesce("_odds", F.lit(0.0))))).alias("toxicity_score"))


def train_toxicity(labelled: DataFrame, text: str = "text", label: str = "label",
                   features: int = 1 << 16, iterations: int = 10) -> PipelineModel:
    """A logistic regression over hashed words, trained on the whole table."""
    stages = [
        Tokenizer(inputCol=text, outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        Normalizer(inputCol="_counts", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.001,
                           probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction"),
    ]
    return Pipeline(stages=stages).fit(labelled.where(F.col(text).isNotNull()).select(text, label))


def toxicity_score(df: DataFrame, model, text: str = "text", result: str = "toxicity_score") -> DataFrame:
    """Add the probability of class 1; 0 for missing texts.

    `model` is any transformer that fills `_probability`."""
    scored = model.transform(df.withColumn("_missing", F.col(text).isNull()).fillna({text: ""}))
    score = F.when(F.col("_missing"), 0.0).otherwise(vector_to_array("_probability")[1])
    return scored.withColumn(result, score).select(*df.columns, result)


def text_embedding(df: DataFrame, text: str = "text", dimension: int = 64, result: str = "embedding",
                   vocabulary: Sequence[str] | None = None) -> DataFrame:
    """Add a unit vector of word counts, for tables without embeddings: of words hashed to `dimension`
    places, or of the words of a `vocabulary`, one place each (zeros for a text that has none of them)."""
    words = Tokenizer(inputCol=text, outputCol="_words").transform(df.fillna({text: ""}))
    counter = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension) if vocabulary is None else \
        CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="_words", outputCol="_counts")
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counter.transform(words))
    return unit.withColumn(result, vector_to_array("_unit")).select(*df.columns, result)
