"""Hard negatives against the scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm.hard_negatives import Bucket, hard_negatives, integer_rows

_SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every, width):
    sound = []
    for d, x, label in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) and abs(c) < 2**20 for c in x):
            sound.append((d, [math.floor(256 * float(np.float32(c))) for c in x] + [0] * (width - len(x)), label))
    key = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    out = []
    for i, (a, x, label) in enumerate(sound):
        if a is None or a % every:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), d, other) for j, (d, y, other) in enumerate(sound) if j != i]
        positives = sorted((s for s in scored if s[2] == label), key=key)[:5]
        for score, d, _ in positives:
            fits = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score]
            out += [(a, d, k, n[1], score, n[0]) for k, n in enumerate(sorted(fits, key=key)[:5], 1)]
    return sorted(out, key=str)


def got(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.select(names).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(400):
        x = [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]
        rows.append((i, x, rng.randrange(4)))
    rows += [(i, rows[10][1], rows[10][2]) for i in range(400, 520)]  # one hot vector
    rows += [(i, rows[10][1], 3 - rows[10][2]) for i in range(520, 540)]
    rows += [(600, None, 1), (601, [1.0] * 8, None), (602, [None] + [1.0] * 7, 1), (603, [float("nan")] * 8, 1), (604, [float("inf")] * 8, 2)]
    rows += [(605, [2.0**21] * 8, 1), (606, [0.0] * 8, 1), (610, [0.0] * 8, 2), (607, [1.0, 2.0], 1), (608, [], 2), (None, rows[10][1], 1), (None, rows[11][1], 2)]
    rows += [(20, rows[20][1], rows[20][2]), (20, rows[21][1], 1), (40, rows[40][1], 0)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"bucket": 16, "shard_rows": 90, "chunk": 7}])
def test_all_pairs(spark, rows, sizes):
    table = spark.createDataFrame(rows, _SCHEMA).withColumns({c: F.lit("x") for c in ("row", "vec", "shard", "id", "p")})
    assert got(hard_negatives(integer_rows(table), every=10, **sizes)) == plain(rows, 10, 8)


def test_empty_tables(spark, rows):
    table = spark.createDataFrame(rows, _SCHEMA)
    assert hard_negatives(integer_rows(table.limit(0))).count() == 0
    assert hard_negatives(integer_rows(table.where("vec_id % 100 <> 0"))).count() == 0


def test_candidates_lose_nothing_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 8))
    x = centres[rng.integers(0, 40, 2000)] + rng.normal(0, 0.05, (2000, 8))
    x = np.floor(x / np.sqrt((x**2).sum(axis=1))[:, None] * 1000).astype(np.int64)  # of one length, as in a bucket
    bucket = Bucket(np.arange(2000), np.arange(2000), np.zeros(2000, int), x)
    seen = 0
    for anchor in x[:50]:
        scores = x @ anchor
        least = int(np.sort(scores)[-20])
        flags = bucket.candidates(anchor, float(np.sqrt((anchor.astype(float) ** 2).sum())), least)
        assert flags[scores >= least].all()
        assert (bucket.scores(anchor, np.flatnonzero(flags)) == scores[flags]).all()
        seen += flags.sum()
    assert seen < 0.5 * 50 * 2000
