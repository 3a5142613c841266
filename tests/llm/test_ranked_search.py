"""Ranked search against a score for every pair."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import ranked_search as R
from corpus_spark.llm.ranked_search import search

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, top=10):
    cut = [(d, _TERM.findall((t or "").translate(_LOWER))) for d, t in docs]
    cut = [(d, w) for d, w in cut if w]
    total, df = sum(len(w) for _, w in cut), {}
    for _, w in cut:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, w in cut:
            m = 25 + 75 * len(w) * len(cut) // total
            score = 0
            for x in _TERM.findall((text or "").translate(_LOWER)):
                if tf := w.count(x):
                    weight = math.floor(1000 * math.log((2 * len(cut) + 2) / (2 * df[x] + 1)))
                    score += weight * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        for rank, (score, known, d) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, d if known else None, -score))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def texts():
    rng = random.Random(11)
    words = [f"{w}{i}" for i in range(60) for w in ("a", "É", "xß")]
    pick = lambda n: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(n))
    docs = [(i, pick(rng.randrange(0, 40)) + rng.choice(["", " a0,A0_a0", "\x7f"])) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(300, 360)]  # ties
    docs += [(None, docs[3][1]), (5, "a1 a2"), (5, "a1 a2"), (400, None), (401, ""), (402, "a1 " * 30_000)]
    items = [(i, pick(rng.randrange(1, 15))) for i in range(30)] + [(30, docs[3][1]), (31, None), (32, "nowhere"), (33, "a1 a1 A1"), (33, "a1")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, texts, monkeypatch, small):
    if small:  # several blocks, shards and false hits of the bitmaps
        monkeypatch.setattr(R, "BLOCK_ITEMS", 7)
        monkeypatch.setattr(R, "SHARD_BYTES", 900)
    docs, items = texts
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "term": F.lit("x"), "shard": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id int, text string").withColumns({"item": F.lit(1), "block": F.lit("y"), "doc_id": F.lit(0)})
    assert got(search(table.repartition(3), asked)) == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit("- -")), items), (docs, items.withColumn("text", F.lit(None).cast("string")))):
        assert search(d, i).count() == 0


def test_pruning_keeps_ties_and_recreates_nothing(spark, texts):
    """More equal best documents than places, over several shards."""
    docs = [(i, "rare common common" if i % 3 else "common filler word") for i in range(200)]
    items = [(1, "rare common"), (2, "common"), (3, "filler word rare")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(search(table, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)
