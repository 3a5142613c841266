"""Blocks, batches and padding against hand-made answers and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.functions import attention_mask, pad_array
from corpus_spark.operators import packing as P


def frame(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id int, ids array<bigint>")


def blocks(df):
    rows = sorted(df.collect(), key=lambda r: (r.batch, r.block))
    return [r.ids for r in rows]


def test_block_fixtures(spark):
    df = frame(spark, [[1, 2, 3], [4, 5, 6, 7], [8, 9, 10]])
    assert blocks(P.pack_blocks(df, "ids", 4, "id")) == [[1, 2, 3, 4], [5, 6, 7, 8]]
    assert blocks(P.pack_blocks(frame(spark, [[1, 2]]), "ids", 4, "id")) == [[1, 2]]
    assert blocks(P.pack_blocks(frame(spark, [[], []]), "ids", 4, "id")) == []


def test_wrapped_fixture(spark):
    df = frame(spark, [[101, 1, 2, 102], [101, 3, 4, 5, 102]])
    assert blocks(P.pack_wrapped(df, "ids", 5, "id")) == [[101, 1, 2, 3, 102]]


def test_constant_length(spark):
    df = frame(spark, [[1, 2], [3], [4, 5, 6]])
    assert blocks(P.pack_constant(df, "ids", 4, 9, "id")) == [[1, 2, 9, 3], [9, 4, 5, 6]]
    assert blocks(P.pack_constant(frame(spark, [[1]]), "ids", 4, 9, "id")) == []


def group_by_hand(lists, size, keep_short=True):
    flat = [x for one in lists for x in one]
    total = len(flat)
    if total >= size or not keep_short:
        total = total // size * size
    return [flat[i : i + size] for i in range(0, total, size)]


@pytest.mark.parametrize("bucket_rows", [20, 100_000])
@pytest.mark.parametrize("block,batch_rows", [(1, 7), (8, 10), (64, 1000)])
def test_blocks_equal_brute_force(spark, bucket_rows, block, batch_rows):
    rng = random.Random(block)
    rows = [
        (i, rng.choice(["train", "train", "test"]), [rng.randint(1, 99) for _ in range(rng.randint(0, 30))])
        for i in range(203)
    ]
    df = spark.createDataFrame(rows, "id int, split string, ids array<bigint>").repartition(4)
    df = df.withColumn("twice", F.transform("ids", lambda x: x * 2))
    got = P.pack_blocks(
        df, "ids", block, "id", batch_rows, "split", ["twice"], bucket_rows=bucket_rows
    ).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.batch, r.block)):
        found.setdefault(r.split, []).append(r.ids)
        assert r.twice == [2 * x for x in r.ids] and r.labels == r.ids
    for split in ("train", "test"):
        lists = [r[2] for r in rows if r[1] == split]
        wanted = []
        for start in range(0, len(lists), batch_rows):
            wanted += group_by_hand(lists[start : start + batch_rows], block)
        assert found[split] == wanted


def test_one_document_over_many_blocks(spark):
    df = frame(spark, [list(range(5)), list(range(1000)), [7]])
    flat = [*range(5), *range(1000), 7]
    assert blocks(P.pack_blocks(df, "ids", 10, "id")) == [flat[i : i + 10] for i in range(0, 1000, 10)]


def test_block_size():
    assert P.resolve_block_size(None, 4096) == 1024
    assert P.resolve_block_size(None, 512) == 512
    assert P.resolve_block_size(2048, 1024) == 1024
    assert P.resolve_block_size(64, 1024) == 64


def test_padding(spark):
    df = frame(spark, [[1, 2], [3]])
    rows = df.select(pad_array(F.col("ids"), 2, 0).alias("ids")).withColumn(
        "m", attention_mask(F.col("ids"), 0)
    ).collect()
    assert [r.ids for r in rows] == [[1, 2], [3, 0]]
    assert [r.m for r in rows] == [[1, 1], [1, 0]]
    batch = P.assemble_batches(df.withColumn("labels", F.col("ids")), ["ids", "labels"], 2, "id")
    row = P.pad_batches(batch, {"ids": 0, "labels": -100}, mask_of="ids").first()
    assert row.ids == [[1, 2], [3, 0]] and row.labels == [[1, 2], [3, -100]]
    assert row.attention_mask == [[1, 1], [1, 0]]


@pytest.mark.parametrize("bucket_rows", [9, 100_000])
def test_batches(spark, bucket_rows):
    df = spark.range(50).withColumn("x", F.col("id") * 2).repartition(3)
    got = P.assemble_batches(df, ["id", "x"], 8, "id", bucket_rows=bucket_rows).collect()
    got.sort(key=lambda r: r.batch)
    assert [r.id for r in got] == [list(range(i, min(i + 8, 50))) for i in range(0, 50, 8)]
    assert got[-1].n_rows == 2 and got[0].x == [0, 2, 4, 6, 8, 10, 12, 14]


def test_shuffled_batches_hold_every_row(spark):
    got = P.assemble_batches(spark.range(50), ["id"], 8, "id", shuffle_seed=1).collect()
    flat = [x for r in sorted(got, key=lambda r: r.batch) for x in r.id]
    assert sorted(flat) == list(range(50)) and flat != list(range(50))


def test_ragged(spark):
    rows = [(0, [1, 2], 1, 5, "x"), (1, [3], 0, 6, "y"), (2, [4], 1, 7, "z"), (3, [5], 1, 8, "w")]
    df = spark.createDataFrame(rows, "id int, ids array<bigint>, label int, extra int, name string")
    batch = P.assemble_batches(df, ["ids", "label", "extra", "name"], 2, "id")
    first, second = sorted(P.collate_ragged(batch, "repeat_first").collect(), key=lambda r: r.batch)
    assert first.ids == [[1, 2], [1, 2]] and first.extra == [5, 5] and first.labels == [1, 0]
    assert first.ragged and not second.ragged
    assert second.ids == [[4], [5]] and second.extra == [7, 8]
    assert "name" not in first.asDict()
    padded = sorted(P.collate_ragged(batch).collect(), key=lambda r: r.batch)
    assert padded[0].ids == [[1, 2], [3, 0]] and padded[0].extra == [5, 6]
    floats = P.collate_ragged(P.assemble_batches(df.withColumn("label", F.lit(0.5)), ["label"], 2, "id"))
    assert floats.schema["labels"].dataType.simpleString() == "array<double>"


def test_wrapped_blocks_allow_empty_sequences(spark):
    df = spark.createDataFrame([(0, [101, 1, 2, 102]), (1, []), (2, [101, 3, 102])], "id long, ids array<bigint>")
    got = P.pack_wrapped(df, "ids", 5, "id", 10).select("ids").collect()
    assert [r.ids for r in got] == [[101, 1, 2, 3, 102]]
