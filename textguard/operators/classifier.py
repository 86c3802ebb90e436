"""Scores of a text model over whole texts, in batches of chunks.

Texts are cut into overlapping chunks of the size a model takes; chunks are scored in
batches (`predict_batch_udf`), with one model per Python worker; and the highest score goes
back to the text. So what stands behind the first chunk counts like what stands in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard import rules
from textguard.operators.toxicity import word_weights

OVERLAP = 64
#: Words of a linear model, which travel with it; the strongest ones are kept.
MAX_WORDS = 200_000
#: Makes a function from an array of texts to an array of probabilities; runs once per worker.
Model = Callable[[], Callable]


def chunk_spans(text: Column, size: int = rules.CLASSIFIER_CHARS, overlap: int = OVERLAP) -> Column:
    """The text in chunks of `size` characters, each starting `overlap` before the last one's end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def linear_model(labelled: DataFrame, text: str = "text", label: str = "label", max_words: int = MAX_WORDS) -> Model:
    """A model by word weights (`toxicity.word_weights`) of distinct words."""
    weights = word_weights(labelled, text, label)
    prior = weights.where("word is null").first()
    strongest = weights.where("word is not null").orderBy(F.desc(F.abs("weight")), "word").limit(max_words).collect()
    shared = labelled.sparkSession.sparkContext.broadcast({r.word: r.weight for r in strongest})
    start = prior.weight if prior else 0.0

    def make():
        import numpy as np

        table = shared.value

        def predict(texts):
            odds = np.array([start + sum(table.get(w, 0.0) for w in set(t.lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")))
                             for t in texts])
            return 1.0 / (1.0 + np.exp(-odds))

        return predict

    return make


def chunk_scores(df: DataFrame, row_id: str, text: str, model: Model, size: int = rules.CLASSIFIER_CHARS,
                 overlap: int = OVERLAP, batch_size: int = 256) -> DataFrame:
    """`row_id, confidence, chunk, n_chunks` per id: the highest probability among its chunks (to nine
    digits), the first chunk that has it, and how many there are. Missing texts have none.

    A text's chunks stay in its task until they are one row, so only that is shuffled."""
    predict = predict_batch_udf(model, return_type=T.DoubleType(), batch_size=batch_size)
    chunks = df.where(F.col(text).isNotNull()).select(F.col(row_id).alias("_id"), F.posexplode(chunk_spans(F.col(text), size, overlap)).alias("chunk", "_text"))
    scored = chunks.select("_id", "chunk", F.round(predict("_text"), 9).alias("confidence"))
    best = scored.groupBy("_id").agg(F.max(F.struct("confidence", (-F.col("chunk")).alias("place"))).alias("best"), F.count("*").alias("n_chunks"))
    return best.select(F.col("_id").alias(row_id), F.col("best.confidence").alias("confidence"), (-F.col("best.place")).alias("chunk"), "n_chunks")


def classify(df: DataFrame, row_id: str, text: str, model: Model, positive: str = "INJECTION", negative: str = "SAFE",
             size: int = rules.CLASSIFIER_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Add `model_label` and `model_score` (the confidence in the label) of whole texts, as
    `sanitize(model=("model_label", "model_score"))` takes them; nulls for missing texts."""
    found = chunk_scores(df, row_id, text, model, size, overlap).select(F.col(row_id).alias("_id"), "confidence")
    joined = df.join(found, F.col(row_id) == F.col("_id"), "left")
    says = F.col("confidence") > 0.5
    return joined.select(*df.columns, F.when(says, positive).when(~says, negative).alias("model_label"),
                         F.when(says, F.col("confidence")).otherwise(1 - F.col("confidence")).alias("model_score"))
