"""Suffix-array and substring dedup against plain search for repeated strings."""

import hashlib
import random

import numpy as np
import pytest
from llm import brute
from pyspark.sql import functions as F

from corpus_spark.llm import repeats as R
from corpus_spark.llm.substring import substring_dedup, substring_report, substring_spans
from corpus_spark.llm.suffix_array import suffix_array_dedup, suffix_array_report


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = " ".join(rng.choice(["the", "of", "ab", "stu", "xéy"]) for _ in range(300))
    rows = []
    for i in range(90):
        a, b = sorted((rng.randrange(len(base)), rng.randrange(len(base))))
        start = rng.choice(["", "zz ", "q" * 150])
        rows.append((i * 3, start + base[a:b] + rng.choice(["", f" tail {rng.random()}"])))
    rows += [(1, None), (2, ""), (4, " \t"), (5, "a" * 700), (7, "ab" * 300), (8, "é" * 120), (None, base[:250])]
    return rows


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("hot", [False, True])
def test_suffix_array(table, rows, hot, monkeypatch):
    if hot:  # every repeated trigger takes the way of the very frequent ones
        monkeypatch.setattr(R, "HOT_SAMPLE", 1)
        monkeypatch.setattr(R, "HOT_CONTEXTS", 2)
    got = {r[0]: tuple(r)[1:] for r in suffix_array_report(table).collect()}
    assert got == brute.suffix_report(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_substring(table, rows, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(R, "HOT_SAMPLE", 1)
        monkeypatch.setattr(R, "HOT_CONTEXTS", 2)
    got = {r[0]: tuple(r)[1:] for r in substring_report(table).collect()}
    assert got == brute.substring_report(rows)


def test_repeated_rows_and_other_columns(table, rows):
    named = table.withColumns({"bucket": F.lit("x"), "id": F.lit(1), "kind": F.lit(None).cast("string")})
    once = {tuple(r) for r in suffix_array_report(table).collect()}
    twice = suffix_array_report(named.unionByName(named)).collect()
    assert {tuple(r) for r in twice} == once and len(twice) == 2 * len(rows)
    cut = suffix_array_dedup(named)
    assert cut.columns == named.columns and cut.count() == len(rows)
    plain = brute.repeats(rows, 100, lambda t: (t or "").encode())
    for r in cut.collect():
        x, gone = plain[r.doc_id]
        text = bytes(b for b, c in zip(x, gone) if not c).decode("utf-8", "ignore")
        assert (r.text or "") == text and r.bucket == "x"


def test_texts_that_share_an_id(spark, rows):
    """Only the text that repeats is cut, not another one under its id or without an id."""
    long = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i * 7}" for i in range(90))
    third = " ".join(f"third{i * 3}" for i in range(60))
    odd = [(9, f"start {long} end"), (9, f"{other} {third}"), (9, third), (3, long), (None, f"x {other}"), (None, f"{long} y"), (None, "own " + "w" * 300)]
    table = spark.createDataFrame(odd + rows, "doc_id long, text string")
    tagged = table.select("doc_id", "text", F.xxhash64("doc_id", F.col("text").cast("binary"))).collect()
    tagged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    plain = list(enumerate(r[1] for r in tagged))
    want = [(tagged[i][0], *x) for i, x in brute.suffix_report(plain).items()]
    assert sorted(map(tuple, suffix_array_report(table).collect()), key=str) == sorted(want, key=str)
    want = [(tagged[i][0], *x) for i, x in brute.substring_report(plain).items()]
    assert sorted(map(tuple, substring_report(table).collect()), key=str) == sorted(want, key=str)
    gone = {i: brute.repeats(plain, 100, lambda t: (t or "").encode())[i] for i, _ in plain}
    want = [(tagged[i][0], bytes(b for b, c in zip(*gone[i]) if not c).decode("utf-8", "ignore")) for i in gone]
    got = [(r.doc_id, r.text or "") for r in suffix_array_dedup(table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(table):
    assert suffix_array_report(table.limit(0)).count() == 0
    assert substring_report(table.limit(0)).count() == 0


def test_triggers_do_not_depend_on_the_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 3000, 3099, 9000])
    unit = R.Unit(words=False, length=100, trigger=32)
    whole = R.triggers(data, offsets, unit)
    monkeypatch.setattr(R, "CORE", 700)
    for a, b in zip(whole, R.triggers(data, offsets, unit)):
        assert (a == b).all()
    place = offsets[whole[0]] + whole[1]
    for doc in (2, 4):  # every string of 100 bytes holds a trigger
        for i in range(offsets[doc], offsets[doc + 1] - 99):
            assert ((place >= i) & (place + 32 <= i + 100)).any()


def test_texts_and_passages_of_word_runs(spark):
    """Texts, passages and the report tell the same; other columns come along, NULL text stays NULL."""
    run = [f"r{i}" for i in range(8)]
    rows = [
        (1, "a  b " + " ".join(run) + " c", "x"),
        (2, "d " + "\n".join(run) + "  e  f", None),
        (3, "g\th  i", "y"),
        (4, None, "z"),
        (None, "", "w"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    texts = {(r.doc_id, r.tag): r.text for r in substring_dedup(docs, length=5).collect()}
    assert texts == {(1, "x"): rows[0][1], (2, None): "d e f", (3, "y"): rows[2][1], (4, "z"): None, (None, "w"): ""}
    spans = [tuple(r) for r in substring_spans(docs, length=5).collect()]
    assert spans == [(2, 1, 8, "\n".join(run))]
    report = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_report(docs, length=5).collect()}
    assert report[2] == (11, 8, hashlib.sha256(b"d e f").hexdigest())
    assert substring_spans(docs.limit(0), length=5).count() == 0
