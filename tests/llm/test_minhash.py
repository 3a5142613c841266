"""Near-duplicates against all pairs."""

import math
import random

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from corpus_spark.llm import minhash as M
from corpus_spark.llm.components import components
from corpus_spark.llm.minhash import circulant_signatures, near_duplicates


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(rng.randrange(3, 60))] for _ in range(20)]
    rows = []
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"E{rng.randrange(5)}"
        rows.append((i, " ".join(w) if i % 37 else rng.choice([None, "", " \t"])))
    return rows


def test_near_duplicates(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    named = table.withColumns({"id": F.lit("x"), "n": F.lit(0), "component": F.lit(1)})
    got = near_duplicates(named.unionByName(named.where("doc_id < 60"))).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_duplicates(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (200, 201)]
    got = components(spark.createDataFrame(chain + star, "u long, v long")).collect()
    found = {r.node: r.component for r in got}
    assert found == {n: c for n, c in brute.components({n for e in chain + star for n in e}, chain + star).items() if n in found}
    assert all(found[n] == 0 for n in range(1, 41)) and all(found[100 + i] == 100 for i in range(1, 60))


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(2)
    shared = rng.integers(1, 2**63, 600, dtype=np.uint64)
    a = np.concatenate([shared, rng.integers(1, 2**63, 100, dtype=np.uint64)])
    b = np.concatenate([shared, rng.integers(1, 2**63, 100, dtype=np.uint64)])
    sig = circulant_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    assert abs((sig[0] == sig[1]).mean() - 600 / 800) < 0.08


def test_the_estimate_loses_fewer_links_than_the_banding():
    n, p = M.BANDS * M.ROWS, M.PERCENT / 100
    least = round(M.ESTIMATE * n)
    lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
    assert lost < (1 - p**M.ROWS) ** M.BANDS
