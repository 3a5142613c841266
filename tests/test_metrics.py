"""Metric fixtures and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.functions import argmax
from corpus_spark.operators import metrics as M
from corpus_spark.operators.udf import apply_metrics
from corpus_spark.plans.evaluate import evaluate, reward_report, reward_summary


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "a array<double>")
    assert [r[0] for r in df.select(argmax(F.col("a"))).collect()] == [1, 0]


def test_class_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 1])), "y int, p int")
    got = values(M.weighted_scores(df, "y", "p"))
    assert got == pytest.approx({"precision": 0.85, "recall": 0.8, "f1": 0.780952, "accuracy": 0.8}, abs=1e-6)
    assert values(M.binary_scores(df, "y", "p")) == pytest.approx({"accuracy": 0.8, "f1": 0.857143}, abs=1e-6)
    both = apply_metrics(df, [lambda d: M.accuracy(d, "y", "p"), lambda d: M.binary_scores(d, "y", "p")])
    assert both.count() == 3


def test_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([(0, 1), (1, 1)], "y int, p int")
    got = values(M.weighted_scores(df, "y", "p"))
    assert got == pytest.approx({"precision": 0.25, "recall": 0.5, "f1": 1 / 3, "accuracy": 0.5})
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert values(M.binary_scores(none, "y", "p")) == {"accuracy": 1.0, "f1": 0.0}


def test_next_token(spark):
    df = spark.createDataFrame([([9, 1, 2], [1, 5, 2]), ([3], [3])], "y array<int>, p array<int>")
    row = M.next_token_accuracy(df, "y", "p").first()
    assert (row.hits, row.total, row.accuracy) == (1, 2, 0.5)
    masked = spark.createDataFrame([([9, -100, 2], [1, 2, 2])], "y array<int>, p array<int>")
    assert M.next_token_accuracy(masked, "y", "p").first().accuracy == 0.5
    assert M.next_token_accuracy(masked, "y", "p", ignore_index=-100).first().accuracy == 1.0


def test_auc_fixture(spark):
    rows = list(zip([1, 0, 1, 1, 0, 0], [0.5, 0.2, 0.99, 0.3, 0.1, 0.7]))
    df = spark.createDataFrame(rows, "y int, s double")
    assert M.roc_auc(df, "y", "s").first().value == pytest.approx(7 / 9)
    assert M.roc_auc(df.where("y = 1"), "y", "s").first().value is None


@pytest.mark.parametrize("bucket_rows", [20, 100_000])
def test_auc_brute_force(spark, bucket_rows):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 300) / 10) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wanted = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert M.roc_auc(df, "y", "s", bucket_rows=bucket_rows).first().value == pytest.approx(wanted)


def test_perplexity(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1000.0)], "k string, loss double")
    got = {r.k: r.perplexity for r in M.perplexity(df, "loss", ["k"]).collect()}
    assert got == {"a": 1.0, "b": math.inf}


def test_counts(spark):
    df = spark.createDataFrame([("train",)] * 5 + [("test",)] * 2, "split string")
    got = {r.split: r.samples for r in M.effective_samples(df, {"train": 3, "test": 9}).collect()}
    assert got == {"train": 3, "test": 2}
    share = {r.split: r.share for r in M.label_distribution(df, "split").collect()}
    assert share == pytest.approx({"train": 5 / 7, "test": 2 / 7})


def test_length_report(spark):
    df = spark.createDataFrame([([1] * n,) for n in (1, 2, 3, 10)], "a array<int>")
    got = values(M.length_report(df, "a", (0.5,)))
    assert got == {"rows": 4.0, "min": 1.0, "mean": 4.0, "max": 10.0, "p50": 2.5}


def test_rewards(spark):
    rows = [(i, "q", "b", "a", float(i), float(i * i)) for i in range(40)]
    df = spark.createDataFrame(
        rows,
        "id int, query string, response_before string, response_after string, "
        "reward_before double, reward_after double",
    )
    report = reward_report(df, "id")
    assert report.count() == 16 and report.first().text_after == "qa"
    got = {r.column: (r["mean"], r["median"]) for r in reward_summary(df).collect()}
    assert got["reward_before"] == (19.5, 19.5) and got["reward_after"][1] == (19**2 + 20**2) / 2


def test_evaluate(spark):
    rows = [([0.9, 0.1], 0, 0.1), ([0.2, 0.8], 1, 0.8), ([0.6, 0.4], 1, 0.4), ([0.5, 0.5], 0, 0.5)]
    df = spark.createDataFrame(rows, "logits array<double>, y int, s double")
    got = values(evaluate(df, "logits", "y", "s"))
    assert got["accuracy"] == 0.75 and got["roc_auc"] == 0.75


def test_roc_auc_refuses_null(spark):
    rows = [(1, 0.9), (0, 0.1), (None, 0.5), (1, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    with pytest.raises(ValueError, match="2 rows"):
        M.roc_auc(df, "label", "score")
    assert M.roc_auc(df.dropna(), "label", "score").first().value == 1.0
