"""Weights, budgets and odd rows; values are held against SQL."""

import math

import pyarrow.parquet as pq
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from corpus_spark.llm.mixing import mix_sources, mix_sql


@pytest.fixture(scope="module")
def docs(spark):
    sizes = {"big": 900, "mid": 90, "small": 12, None: 20, "": 8, "wordless": 5}
    rows = [(1000 * s + i, "" if name == "wordless" else "w " * (1 + i % 9), name) for s, (name, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(None, "a b c", "mid"), (7, "a b", "big"), (7, "a b", "big"), (9, None, "small")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("name", F.lit(1))


@pytest.mark.parametrize("entropy, epochs, budget", [(0.95, 4.0, 1.0), (0.99, 100.0, 1.0), (0.2, 4.0, 0.3)])
def test_equals_sql(spark, docs, tmp_path, entropy, epochs, budget):
    pq.write_table(docs.toArrow(), tmp_path / "documents.parquet")
    got = mix_sources(docs, entropy=entropy, max_epochs=epochs, budget=budget)
    sql = mix_sql(entropy=entropy, max_epochs=epochs, budget=budget)
    assert differences(got, connect(str(tmp_path)), sql) is None


def test_targets(docs):
    rows = mix_sources(docs, entropy=0.9, max_epochs=50).groupBy("source", "weight").agg(F.sum("n_words").alias("n")).collect()
    total = sum(len((r.text or "").split()) for r in docs.collect())
    weights = [r.weight for r in rows]
    assert math.isclose(sum(weights), 1, abs_tol=1e-6)
    assert -sum(w * math.log(w) for w in weights) >= 0.9 * math.log(len(weights)) - 1e-6
    for r in rows:  # the budget is met but for less than one document
        assert r.weight * total - 10 <= r.n <= r.weight * total + 1


def test_no_source_is_repeated_too_often(docs):
    got = mix_sources(docs, entropy=1.0, max_epochs=3.0)
    assert got.agg(F.max("epoch")).first()[0] <= 3
    sizes = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda x: x != "")))).collect()}
    for r in got.groupBy("source").agg(F.sum("n_words").alias("n")).collect():
        assert r.n <= 3.0 * sizes[r.source] + 1


def test_empty_and_single(docs):
    assert mix_sources(docs.limit(0)).count() == 0
    one = docs.where("source = 'mid' and doc_id is not null")
    assert mix_sources(one).count() == one.count()
