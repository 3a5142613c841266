"""Evaluation and reward reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.constants import REPORT_SAMPLE, SHUFFLE_SEED
from corpus_spark.functions.arrays import argmax
from corpus_spark.operators.metrics import mean_and_median, roc_auc, weighted_scores
from corpus_spark.operators.order import sample_k

__all__ = ["evaluate", "reward_report", "reward_summary"]


def evaluate(
    df: DataFrame, logits: str, label: str, score: str | None = None
) -> DataFrame:
    """(metric, value) of a classifier's logits; with a score also the ROC AUC."""
    guessed = df.withColumn("_pred", argmax(F.col(logits)))
    metrics = weighted_scores(guessed, label, "_pred")
    if score is not None:
        metrics = metrics.unionByName(roc_auc(df, label, score))
    return metrics


def reward_report(
    df: DataFrame, key: str, k: int = REPORT_SAMPLE, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """A sample of ``k`` queries with the texts and rewards before and after."""
    return sample_k(df, k, seed, key).select(
        key,
        F.concat("query", "response_before").alias("text_before"),
        F.concat("query", "response_after").alias("text_after"),
        "reward_before",
        "reward_after",
    )


def reward_summary(df: DataFrame) -> DataFrame:
    """Mean and exact median of the rewards before and after."""
    return mean_and_median(df, ["reward_before", "reward_after"])
