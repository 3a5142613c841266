"""Greedy segments and the buffers cut from them, against row-by-row versions."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import segments as S
from corpus_spark.operators.packing import pack_budget


def by_hand(rows, budget):
    out = {}
    for group in {r[1] for r in rows}:
        segment = total = 0
        for key, _, size in sorted(r for r in rows if r[1] == group):
            out[key] = segment
            total += size or 0
            if total >= budget:
                segment, total = segment + 1, 0
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, rng.choice("ab"), rng.choice([0, 0, None, 3, 9, 40, 300])) for i in range(300)]


# Ranges shorter than a segment, longer, and one; compositions of two parts and of all.
@pytest.mark.parametrize("fan,bucket_rows,budget", [(256, None, 50), (2, 20, 50), (2, 5, 400), (3, 40, 1), (4, 30, 10**6)])
def test_segments_equal_row_by_row(spark, rows, monkeypatch, fan, bucket_rows, budget):
    monkeypatch.setattr(S, "FAN", fan)
    df = spark.createDataFrame(rows, "part int, chain string, before int").repartition(5)  # names used inside
    found = S.budget_segments(df, "part", "before", budget, "chain", bucket_rows=bucket_rows)
    assert found.columns == ["part", "chain", "before", "segment"]
    assert {r.part: r.segment for r in found.collect()} == by_hand(rows, budget)


def test_empty_table_and_wrong_budget(spark, rows):
    df = spark.createDataFrame(rows, "id int, g string, size int")
    assert S.budget_segments(df.limit(0), "id", "size", 10).count() == 0
    with pytest.raises(ValueError):
        S.budget_segments(df, "id", "size", 0)


@pytest.mark.parametrize("partitions,bucket_rows", [(1, 10_000), (200, 25)])
def test_buffers_do_not_depend_on_partitions(spark, partitions, bucket_rows):
    rng = random.Random(2)
    rows = [(i, rng.choice(["train", "test"]), [rng.randrange(9) for _ in range(rng.randrange(12))], rng.randrange(60)) for i in range(150)]
    rows.append((150, "train", None, None))
    want, number = {}, by_hand([(r[0], r[1], r[3]) for r in rows], 200)
    for i, split, ids, _ in rows:
        want.setdefault((split, number[i]), []).extend([*(ids or []), 7])
    want = {k + (b,): ids[b * 8 : b * 8 + 8] for k, ids in want.items() for b in range(len(ids) // 8)}
    df = spark.createDataFrame(rows, "id int, split string, ids array<bigint>, chars int").repartition(partitions)
    df = df.withColumns({"_size": F.lit("x"), "extra": F.lit(1)})
    got = pack_budget(df, "ids", "chars", 8, 7, 200, ["id"], "split", bucket_rows=bucket_rows).collect()
    assert {(r.split, r.buffer, r.block): r.ids for r in got} == want
    assert all(r.labels == r.ids for r in got)
