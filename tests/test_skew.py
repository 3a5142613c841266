"""One token, class and score that hold a third of everything."""

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import metrics as M
from corpus_spark.operators import order as O
from corpus_spark.operators import packing as P
from corpus_spark.operators import tokens as K

ROWS = 6000


@pytest.fixture(scope="module")
def hot(spark):
    third = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        "id",
        F.when(third, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("cls"),
        F.when(third, F.lit(50)).otherwise(F.col("id") * 37 % 101).alias("score"),
        (F.col("id") * 7 % 11 > 4).cast("int").alias("y"),
        F.concat_ws(" ", F.lit("zzz"), F.concat(F.lit("w"), F.col("id") % 400), F.lit("a")).alias("text"),
    ).cache()


def test_unknown_hot_token(hot, monkeypatch):
    monkeypatch.setattr(K, "HEAD_ENTRIES", 8)
    words = K.build_vocab(hot, "text").where("token <> 'zzz'")
    ids = {r.token: r.id for r in words.collect()}
    for r in K.encode(hot, "text", words).select("id", "input_ids").collect():
        assert r.input_ids == [1, ids[f"w{r.id % 400}"], ids["a"]]


@pytest.mark.parametrize("narrow", [500, 500_000])
def test_hot_class_and_score(hot, monkeypatch, narrow):
    monkeypatch.setattr(O, "NARROW_BUCKET_ROWS", narrow)
    ranks = O.exact_rank(hot, ["score", "id"], within="cls", bucket_rows=700)
    worst = ranks.groupBy("cls").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("d"), F.count("*").alias("n"))
    assert worst.where("m <> n OR d <> n").count() == 0
    rows = hot.select("y", "score").collect()
    pos = [r.score for r in rows if r.y]
    neg = [r.score for r in rows if not r.y]
    below = {s: sum(n < s for n in neg) + 0.5 * neg.count(s) for s in set(pos)}
    wanted = sum(below[s] for s in pos) / len(pos) / len(neg)
    assert M.roc_auc(hot, "y", "score").first().value == pytest.approx(wanted)


def test_hot_split_is_packed_whole(hot):
    ids = hot.select("id", "cls", F.array("id", "id", "id").alias("ids"))
    packed = P.pack_blocks(ids, "ids", 10, "id", 100, split="cls", bucket_rows=300)
    counts = {r[0]: r[1] for r in hot.groupBy("cls").count().collect()}
    kept = {r[0]: r[1] for r in packed.groupBy("cls").agg(F.sum(F.size("ids"))).collect()}
    for cls, n in counts.items():
        batches = [100] * (n // 100) + ([n % 100] if n % 100 else [])
        assert kept[cls] == sum(3 * b // 10 * 10 for b in batches)
