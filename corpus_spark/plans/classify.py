"""Text classifiers: one on Spark's own machine-learning library, one on word counts by class."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.functions.arrays import argmax, bind
from corpus_spark.functions.text import WHITE_SPACE, words
from corpus_spark.operators.order import NARROW_BUCKET_ROWS, positions
from corpus_spark.operators.tokens import lookup_list
from corpus_spark.session import materialize

__all__ = ["train_text_classifier", "predict_labels", "CountClassifier", "train_count_classifier", "predict_by_counts"]

MAX_CLASSES = 100


def train_text_classifier(
    df: DataFrame,
    text: str = "text",
    label: str = "labels",
    features: int = 1 << 14,
    iterations: int = 20,
) -> PipelineModel:
    """Words, hashed counts, inverse document frequency, logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=WHITE_SPACE, toLowercase=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.01
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def predict_labels(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``logits`` (an array), ``score`` of class 1 and ``pred``."""
    scored = model.transform(df)
    return (
        scored.withColumn("logits", vector_to_array("rawPrediction"))
        .withColumn("score", F.element_at(vector_to_array("probability"), 2))
        .withColumn("pred", F.col("prediction").cast("int"))
        .drop("_words", "_counts", "_features", "rawPrediction", "probability", "prediction")
    )


@dataclass(frozen=True)
class CountClassifier:
    """What a text earns for each class: ``prior``, ``unseen`` for each word, and the word's weights."""

    classes: list
    label_type: T.DataType
    prior: list[float]
    unseen: list[float]
    table: DataFrame  # (token, id by falling frequency, weights)


def train_count_classifier(df: DataFrame, text: str = "text", label: str = "labels", smoothing: float = 1.0) -> CountClassifier:
    """Multinomial naive Bayes: how often each class holds each word, ``smoothing`` added.

    One pass counts words by class, combined before they move. Rows without a label are
    left out; a NULL text counts as a row without words.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), words(F.col(text)).alias("words"))
    size = F.coalesce(F.size("words"), F.lit(0))
    totals = rows.groupBy("label").agg(F.count("*").alias("rows"), F.sum(size).alias("words")).limit(MAX_CLASSES + 1).collect()
    if not 0 < len(totals) <= MAX_CLASSES:
        raise ValueError(f"{len(totals)} classes; between 1 and {MAX_CLASSES} are possible")
    totals.sort(key=lambda r: r["label"])
    classes, kind = [r["label"] for r in totals], df.schema[label].dataType
    held = F.array(*[F.count_if(F.col("label") == F.lit(c).cast(kind)) for c in classes])
    counts = rows.select("label", F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"), held.alias("held"))
    counts = materialize(counts, "class-counts")
    known, whole = counts.count(), sum(r["rows"] for r in totals)
    table = positions(counts, [-F.col("n"), F.col("token")], name="id", bucket_rows=NARROW_BUCKET_ROWS, written=True)
    weights = F.transform("held", lambda c: F.log((c + F.lit(smoothing)) / F.lit(smoothing)))
    unseen = [math.log(smoothing / (r["words"] + smoothing * known)) if known else 0.0 for r in totals]
    table = materialize(table.select("token", "id", weights.alias("weights")), "class-weights")
    return CountClassifier(classes, kind, [math.log(r["rows"] / whole) for r in totals], unseen, table)


def predict_by_counts(model: CountClassifier, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``logits`` and ``probabilities`` (arrays in order of the classes) and ``pred``, the first best class."""
    n = len(model.classes)
    none = F.array(*[F.lit(0.0)] * n)
    source = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    found = lookup_list(df, source, model.table, "token", "weights", "_weights", none)
    earned = F.aggregate("_weights", none, lambda total, w: F.zip_with(total, w, lambda a, b: a + b))
    size = F.size("_weights")
    logits = bind(earned, lambda e: F.array(*[F.get(e, F.lit(i)) + F.lit(model.unseen[i]) * size + F.lit(model.prior[i]) for i in range(n)]))
    found = found.withColumn("logits", logits).drop("_weights")
    shares = bind(F.array_max("logits"), lambda top: F.transform("logits", lambda x: F.exp(x - top)))
    total = F.aggregate("_shares", F.lit(0.0), lambda a, b: a + b)
    found = found.withColumn("_shares", shares).withColumn("probabilities", F.transform("_shares", lambda x: x / total))
    names = F.array(*[F.lit(c).cast(model.label_type) for c in model.classes])
    return found.withColumn("pred", F.get(names, argmax(F.col("logits")))).drop("_shares")
