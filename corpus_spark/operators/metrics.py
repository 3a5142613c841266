"""Counts, classification, ranking and language-model metrics.

Class metrics work on the confusion counts, which are combined before they move
and hold one row per pair of classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.constants import RATIO_EXAMPLES
from corpus_spark.operators.order import (
    OrderBy,
    head_n,
    quantiles_of_counts,
    running_sums,
    value_counts,
)
from corpus_spark.session import materialize

__all__ = [
    "row_counts",
    "label_distribution",
    "chars_per_token",
    "ratio_of",
    "confusion",
    "accuracy",
    "weighted_scores",
    "binary_scores",
    "next_token_accuracy",
    "roc_auc",
    "perplexity",
    "effective_samples",
    "mean_and_median",
    "length_report",
]


def row_counts(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share)."""
    counts = materialize(df.groupBy(label).agg(F.count("*").alias("n")), "label-counts")
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def chars_per_token(
    df: DataFrame,
    text: str,
    ids: str,
    order_by: OrderBy,
    examples: int = RATIO_EXAMPLES,
) -> DataFrame:
    """Characters per token over the first examples in order.

    Where the ids are still to be made, take the first examples before that and use ``ratio_of``.
    """
    return ratio_of(head_n(df, examples, order_by), text, ids)


def ratio_of(first: DataFrame, text: str, ids: str) -> DataFrame:
    """(characters, tokens, ratio) of all rows."""
    chars, count = F.sum(F.length(text)), F.sum(F.size(ids))
    return first.agg(
        chars.alias("characters"), count.alias("tokens"), (chars / count).alias("ratio")
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("pred")).agg(
        F.count("*").alias("n")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 where there is nothing to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(
        top.cast("double") / F.nullif(bottom, F.lit(0)).cast("double")
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("value")).select(F.lit("accuracy").alias("metric"), "value")


def weighted_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one pass."""
    pairs = confusion(df, label, prediction)
    same = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), same.cast("bigint").alias("hits")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    classes = (
        pairs.select(F.explode(sides).alias("s"))
        .groupBy("s.cls")
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum("s.hits").alias("hits"),
        )
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    scored = classes.select("support", "hits", precision.alias("p"), recall.alias("r")).withColumn(
        "f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    )
    total = F.sum("support")
    wide = scored.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / total).alias("f1"),
    )
    return _tall(wide)


def _tall(wide: DataFrame) -> DataFrame:
    """One row of named values to rows (metric, value)."""
    cells = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in wide.columns
    ]
    return wide.select(F.explode(F.array(*cells)).alias("m")).select("m.metric", "m.value")


def binary_scores(df: DataFrame, label: str, prediction: str, positive: int = 1) -> DataFrame:
    """Accuracy and F1 of the positive class."""
    actual, guess = F.col(label) == positive, F.col(prediction) == positive
    hits, support = F.count_if(actual & guess), F.count_if(actual)
    guessed = F.count_if(guess)
    wide = df.agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        _ratio(2 * hits, support + guessed).alias("f1"),
    )
    return _tall(wide)


def next_token_accuracy(
    df: DataFrame, labels: str, predictions: str, ignore_index: int | None = None
) -> DataFrame:
    """Share of positions where the prediction equals the following label.

    Ignored positions count unless ``ignore_index`` is given.
    """
    pairs = F.zip_with(
        F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))),
        F.slice(predictions, 1, F.greatest(F.size(predictions) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    if ignore_index is not None:
        pairs = F.filter(pairs, lambda p: p["a"] != ignore_index)
    hits = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    rows = df.select(hits.alias("hits"), F.size(pairs).alias("total"))
    return rows.agg(
        F.sum("hits").alias("hits"),
        F.sum("total").alias("total"),
        (F.sum("hits") / F.sum("total")).alias("accuracy"),
    )


def roc_auc(
    df: DataFrame, label: str, score: str, positive: int = 1, bucket_rows: int | None = None
) -> DataFrame:
    """Area under the ROC curve; ties count half. NULL with a single class.

    A NULL score or label has no place in the curve: such rows are an error.
    """
    is_positive = F.col(label) == positive
    scores = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(is_positive).cast("bigint").alias("pos"),
        F.count_if(~is_positive).cast("bigint").alias("neg"),
        F.count("*").alias("n"),
    )
    scores = materialize(scores, "roc-scores")
    known = F.when(F.col("score").isNotNull(), F.col("pos") + F.col("neg")).otherwise(0)
    missing = scores.agg(F.sum(F.col("n") - known)).first()[0]
    if missing:
        raise ValueError(f"{missing} rows have a NULL score or label")
    scores = scores.drop("n")
    ranked = running_sums(scores, "score", ["neg"], bucket_rows=bucket_rows)
    below = F.col("neg_cum") - F.col("neg") / 2
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(
        (F.sum(F.col("pos") * below) / F.nullif(pairs, F.lit(0.0))).alias("value")
    ).select(F.lit("roc_auc").alias("metric"), "value")


def perplexity(df: DataFrame, loss: str, by: Sequence[str] = ()) -> DataFrame:
    """exp of the mean loss; too large a loss gives Infinity."""
    mean = F.avg(F.col(loss).cast("double"))
    return df.groupBy(*by).agg(mean.alias("loss"), F.exp(mean).alias("perplexity"))


def effective_samples(df: DataFrame, limits: Mapping[str, int], split: str = "split") -> DataFrame:
    """Row count per split, capped by the limit of that split where there is one."""
    counts = df.groupBy(split).agg(F.count("*").alias("n"))
    limit = None
    for name, value in limits.items():
        limit = (F if limit is None else limit).when(F.col(split) == name, F.lit(value))
    samples = F.col("n") if limit is None else F.least(limit, F.col("n"))
    return counts.withColumn("samples", samples.cast("bigint"))


def mean_and_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, median); the median is exact and interpolated."""
    counts = value_counts(df, columns)
    result = None
    for column in columns:
        one = counts.where(F.col("column") == column)
        middle = quantiles_of_counts(one, [0.5]).select("value").scalar()
        row = one.agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")).select(
            F.lit(column).alias("column"), "mean", middle.alias("median")
        )
        result = row if result is None else result.unionByName(row)
    return result


def length_report(
    df: DataFrame, column: str, quantiles: Sequence[float] = (0.5, 0.9, 0.99)
) -> DataFrame:
    """(metric, value) of the lengths of an array column, from one pass over it."""
    counts = value_counts(df.select(F.size(column).alias("size")), ["size"])
    wide = counts.agg(
        F.sum("n").alias("rows"),
        F.min("value").alias("min"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("value").alias("max"),
    )
    marks = quantiles_of_counts(counts, quantiles).select(
        F.concat(F.lit("p"), F.round(F.col("quantile") * 100).cast("int")).alias("metric"), "value"
    )
    return _tall(wide).unionByName(marks)
