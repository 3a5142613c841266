"""What the physical plans must not contain."""

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import order as O
from corpus_spark.operators import packing as P
from corpus_spark.operators import schema as S
from corpus_spark.operators import tokens as K

PYTHON = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """The plan without its subquery trees, which read small tables; for plans without joins."""
    lines = plan_of(df).splitlines()
    return "\n".join(line for line in lines if not line.lstrip().startswith(":"))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    texts = spark.range(400).select("id", F.repeat(F.concat(F.lit("w"), "id", F.lit(" x\n\n")), 5).alias("text"), F.lit("z").alias("unused"))
    texts.repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_repack_is_narrow_and_evaluated_once(docs):
    plan = plan_of(S.repack_filter(docs.select("id", "text"), "text", 12))
    assert "Exchange" not in plan and not any(p in plan for p in PYTHON)
    assert plan.count("aggregate(") == 1
    assert "unused" not in plan


def test_split_and_head_do_not_move_rows(docs):
    for df in (
        O.split_exact(docs, "id", bucket_rows=50),
        O.head_n(docs, 100, "id", bucket_rows=50),
        O.take_per_group(docs, "unused", {"z": 50}, "id", bucket_rows=50),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_encode_is_narrow(docs):
    vocab = K.build_vocab(docs, "text")
    main = main_plan(K.encode(docs, "text", vocab))
    assert "FileScan" in main and "Exchange" not in main and not any(p in main for p in PYTHON)


def test_lookup_and_split_points_are_no_columns(docs, monkeypatch):
    """As columns they would be copied into every row; cut off tokens are not probed at all."""
    vocab, written = K.build_vocab(docs, "text"), []
    monkeypatch.setattr(K, "HEAD_ENTRIES", 8)
    monkeypatch.setattr(K, "materialize", lambda df, label: written.append(df) or df)
    K.encode(docs, "text", vocab, max_len=3)
    assert len(written) == 1 and "AS _lookup" not in plan_of(written[0])
    assert written[0].agg(F.max(F.size("_found"))).first()[0] == 3
    written.clear()
    K.sft_encode(docs.withColumn("answer", F.lit(" x x")), "text", "answer", vocab, 3)
    assert written[0].agg(F.max(F.size("_found"))).first()[0] == 6
    assert "AS _points" not in plan_of(O.positions(docs, "id", bucket_rows=50))


def test_packing_moves_each_row_once(docs):
    ids = docs.select("id", F.array(F.col("id"), F.col("id")).alias("ids"))
    plan = main_plan(P.pack_blocks(ids, "ids", 4, "id", 10, bucket_rows=40))
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan
    assert not any(p in plan for p in PYTHON)


def test_rank_is_not_one_task(docs):
    plan = main_plan(O.exact_rank(docs, "id", bucket_rows=40))
    assert "SinglePartition" not in plan and plan.count("Exchange") == 1
