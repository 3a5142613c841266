"""Every stage of the pipeline against a plain version on its own input."""

import os

import pyarrow.parquet as pq
import pytest
from llm import brute
from oracle import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_spark.llm.mixing import mix_sql
from corpus_spark.llm.toxicity import learn_toxicity, score_toxicity
from corpus_spark.session import materialize

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], SF_DIR), name.replace(" ", "-")))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_result(spark, steps):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(steps) == 6
    assert all(s.columns == steps[0].columns for s in steps[1:5])
    again = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, steps[5].collect()))


def test_toxic_documents_go(spark, steps):
    scored = score_toxicity(steps[0], learn_toxicity(steps[0], spark.read.parquet(f"{SF_DIR}/labels.parquet")))
    assert set(texts(steps[1])) == {r.doc_id for r in scored.where("score < 0.5").collect()}


def test_one_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert set(after) == {d for d, (_, _, kept) in brute.near_duplicates(list(before.items())).items() if kept}
    assert all(after[d] == before[d] for d in after)


def test_repeated_strings_are_cut(steps):
    before, after = texts(steps[2]), texts(steps[3])
    wanted = brute.repeats(list(before.items()), 100, lambda t: (t or "").encode())
    for d, (x, cut) in wanted.items():
        assert after[d] == bytes(b for b, c in zip(x, cut) if not c).decode("utf-8", "ignore")
    assert steps[3].where(F.col("n_chars") != F.length("text")).count() == 0 and set(after) == set(before)


def test_benchmark_items_go(spark, steps):
    before, after = texts(steps[3]), texts(steps[4])
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    exact = {d for d, t in before.items() if any(x in t for x in items)}
    assert not exact & set(after) and all(after[d] == before[d] for d in after)
    assert len(before) - len(after) <= len(exact) + 5


def test_mixing_equals_sql(spark, steps, tmp_path):
    pq.write_table(steps[4].toArrow(), tmp_path / "documents.parquet")
    taken = steps[5].drop("text", "lang", "n_chars")
    assert differences(taken, connect(str(tmp_path)), mix_sql()) is None
    before = texts(steps[4])
    assert all(r.text == before[r.doc_id] for r in steps[5].collect())


def test_odd_rows_pass_every_stage(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "a", None), (2, "", None, "a", None), (3, "word " * 9000, "en", "b", 5)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF_DIR), "odd")
            if name == "minhash near-dedup":  # of the two rows of id 2 one goes
                assert docs.count() == (0 if table.isEmpty() else 4)
        # Of the sources only b has words; the others have weight 0.
        assert docs.count() == (0 if table.isEmpty() else 1)
        assert [r.text for r in docs.collect()] == ([] if table.isEmpty() else ["word "])  # the rest repeats


def test_texts_under_one_id_stay_whole(spark):
    """Without an id, or under one id, only the text that repeats is cut."""
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    long = " ".join(f"word{i}" for i in range(200))
    own = " ".join(f"other{i * 7}" for i in range(90))
    rows = [(1, long, "en", "a", 0), (None, f"{long[300:900]} and {own[:150]}", "en", "a", 0), (None, own[150:], "en", "a", 0)]
    table = spark.createDataFrame(rows, schema)
    kept = sorted(r.text for r in corpus_pipeline.suffix_dedup(spark, table, SF_DIR).collect())
    assert own[150:] in kept and len(kept) == 3


def test_near_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    rows = [(i, f"a text of its own {i} {i * 7} {i * 3} words", "en", "a", 0) for i in range(50)]
    table = spark.createDataFrame(rows + rows[:20] + [(100, rows[3][1], "fr", "b", 1)], schema)
    kept = corpus_pipeline.near_dedup(spark, table, SF_DIR)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == list(range(50))
