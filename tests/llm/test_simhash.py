"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from corpus_spark.llm.simhash import cell_steps, fingerprint_links, forest, simhash_groups
from corpus_spark.llm.components import components


def _got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_groups_of_odd_rows(spark):
    rng = random.Random(5)
    base = [" ".join(f"{rng.choice('abcde')}{rng.randrange(30)}" for _ in range(rng.randrange(1, 80))) for _ in range(12)]
    rows = [(i, rng.choice(base) + rng.choice(["", "", " x", " É ß"])) for i in range(150)]
    rows += [(None, base[0]), (None, None), (7, "one text of its own"), (7, None), (200, ""), (201, " \t\n"), (202, "two words"), (203, "TWO  words")]
    rows += [(300, "w " * 70_000 + "end"), (301, "w " * 70_000 + "END"), (None, "left alone here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    named = table.withColumns({"fp": F.lit("x"), "least": F.lit(0), "component_id": F.lit(1), "_salt": F.lit(2), "cell": F.lit(3)})
    assert _got(simhash_groups(named, tile=3)) == sorted(brute.simhash_groups(rows), key=str)


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tile", [7, 2048])
def test_links_of_dense_fingerprints(spark, tile):
    """Thousands of links within few cells: the components are those of all pairs."""
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (400, 3)).astype(np.uint64)
    fps = np.unique(rng.choice(centre, 400) ^ np.bitwise_xor.reduce(flips * (rng.random((400, 3)) < 0.6), axis=1))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.component for r in components(fingerprint_links(table, 2, tile)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps) <= 2
    want = brute.components(fps.view(np.int64).tolist(), [(int(fps.view(np.int64)[i]), int(fps.view(np.int64)[j])) for i, j in zip(*np.nonzero(np.tril(near, -1)))])
    assert got == {n: c for n, c in want.items() if n != c}


def test_forest_and_steps():
    node, root = forest(np.array([5, 4, 1]), np.array([4, 3, 0]), 7)
    assert dict(zip(node.tolist(), root.tolist())) == {4: 3, 5: 3, 1: 0}
    assert len(cell_steps(2)) == 21 and len(cell_steps(0)) == 1


def test_query(spark):
    import os

    from corpus_spark.llm.queries import QUERIES

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(QUERIES["op12_simhash_near_dedup"](spark, sf_dir)) == sorted(brute.simhash_groups(docs), key=str)
