"""Registered queries of the training-data operators: those with SQL against it, the rest by hand."""

import os

import numpy as np
import pyarrow as pa
import pytest
from llm import brute
from oracle import connect, differences

from corpus_spark.llm.buffers import flat_bytes
from corpus_spark.llm.decontaminate import SEED, THRESHOLD, smith_waterman, word_codes
from corpus_spark.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_suffix_array(spark, documents):
    got = {r[0]: tuple(r)[1:5] for r in QUERIES["op1_suffix_array_dedup"](spark, SF_DIR).collect()}
    assert got == brute.suffix_report(documents)


def test_substring(spark, documents):
    got = {r[0]: tuple(r)[1:4] for r in QUERIES["op10_substring_dedup"](spark, SF_DIR).collect()}
    assert got == brute.substring_report(documents)


def test_near_duplicates(spark, documents):
    got = {r[0]: tuple(r)[1:4] for r in QUERIES["op4_minhash_near_dedup"](spark, SF_DIR).collect()}
    assert got == brute.near_duplicates(documents)


def test_decontamination_finds_exact_items(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    exact = {(d, i) for d, t in documents for i, x in items if x and t and x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SF_DIR).collect()}
    assert exact and exact <= got


def test_decontamination_equals_alignment_of_whole_texts(spark, documents):
    """Every item against every whole document with which it shares three words in a row."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]

    def codes(texts):
        found, first = word_codes(*flat_bytes(pa.array(texts, pa.string())))
        return [found[a:b] for a, b in zip(first[:-1], first[1:])]

    def grams(words):
        n = min(SEED, len(words))
        return {tuple(words[i : i + n].tolist()) for i in range(len(words) - n + 1)} if n else set()

    parts, wanted = [(i, w, grams(w)) for (i, _), w in zip(items, codes([t for _, t in items]))], {}
    for (d, _), words in zip(documents, codes([t for _, t in documents])):
        here = grams(words)
        for i, item, seeds in parts:
            if seeds & here:
                score = smith_waterman(item, words)[0] / (2 * len(item))
                if score >= THRESHOLD:
                    wanted[d, i] = score
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op2_decontamination"](spark, SF_DIR).collect()}
    assert wanted and got == wanted


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in QUERIES["op5_hilbert_neighbours"](spark, SF_DIR).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = x @ x[ids == q][0]
        order = [int(ids[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits, total = hits + len(set(order) & set(found[q])), total + len(order)
        assert all(abs(s - scores[ids == v][0]) < 1e-9 for v, s in found[q].items()) and len(found[q]) == len(order)
    assert hits >= 0.9 * total
