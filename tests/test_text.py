"""Hand-computed answers for text functions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpus_spark.constants import ANSWER_MARKER, INFERENCE_PROMPT
from corpus_spark.functions import (
    array_intersection,
    characters,
    chunk_array,
    extract_answer,
    fill_template,
    instruction_with_input,
    strip,
    text_size,
    words,
)
from corpus_spark.operators.schema import repack_filter

U = "　"

REPACK = [
    ("aaa\n\nbb\n\nc", "any", 5, "aaa"),
    ("aaa\n\nbb\n\nc", "any", 6, "aaa\nbb"),
    ("toolong\n\nab\n\ncd", "any", 5, "ab\ncd"),
    ("aaa\n\nbbb", "any", 2, None),
    ("\n\nab", "any", 5, "\nab"),
    ("\n\n", "any", 5, "\n"),
    ("abcdef", "any", 5, None),
    ("abcdef", "any", 6, "abcdef"),
    ("a  b\n\nc", "any", 10, "a  b\nc"),
    (f"a{U}{U}b\n\nc", "any", 10, "a\nb\n\nc"),
    ("a|||||b", "other", 10, "a|||||b"),
    ("a|||||b", "multi_news", 10, "a\nb"),
    ("😀😀\n\nx", "any", 4, "😀😀\nx"),
]


@pytest.mark.parametrize("text,source,limit,expected", REPACK)
def test_repack_fixture(spark, text, source, limit, expected):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = repack_filter(df, "t", limit, source=source).collect()
    assert [r.t for r in rows] == ([] if expected is None else [expected])


def closed_form(text, limit, separators):
    """Drop long segments, then keep the longest prefix whose joined length fits."""
    sep = next((s for s in separators if s in text), None)
    if sep is None:
        return text if len(text) <= limit else None
    kept, total = [], -1
    for segment in (s for s in text.split(sep) if len(s) <= limit):
        total += len(segment) + 1
        if total > limit:
            break
        kept.append(segment)
    return "\n".join(kept) if kept else None


def test_repack_equals_closed_form(spark):
    rng = random.Random(1)
    pieces = ["a", "bb", "ccc", " ", "  ", "\n", "\n\n", U, U + U, "|||||", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(400)]
    separators = (U + U, "\n\n", "  ")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for limit in (0, 3, 8):
        found = {r.id: r.t for r in repack_filter(df, "t", limit, separators).collect()}
        wanted = {i: closed_form(t, limit, separators) for i, t in enumerate(texts)}
        assert found == {i: t for i, t in wanted.items() if t is not None}


def test_white_space_follows_python(spark):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 　  "
    texts = [f"{s}a{s}{s}b {s}" for s in spaces] + ["", spaces, "​x​ y", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    t = F.col("t")
    rows = df.select("id", words(t).alias("w"), strip(t).alias("s"), text_size(t).alias("n")).collect()
    for r in rows:
        assert r.w == texts[r.id].split()
        assert r.s == texts[r.id].strip()
        assert r.n == len(texts[r.id].split())


def test_characters_are_code_points(spark):
    df = spark.createDataFrame([("a😀中",), ("",)], "t string")
    assert [r[0] for r in df.select(characters(F.col("t"))).collect()] == [["a", "😀", "中"], []]


def test_template_slots_are_filled_once(spark):
    df = spark.createDataFrame([("see {options_} here",)], "t string")
    text = fill_template(INFERENCE_PROMPT, {"sentence1": F.col("t"), "options_": "X"})
    expected = INFERENCE_PROMPT.format(sentence1="see {options_} here", options_="X")
    assert df.select(text).first()[0] == expected


def test_instruction_with_input(spark):
    df = spark.createDataFrame([("i", "x"), ("i", ""), ("i", None)], "a string, b string")
    out = df.select(instruction_with_input(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out] == ["i\nx", "i", "i"]


def test_answer(spark):
    texts = ["x### 回答: y \n", f"q### 回答:{U}z{U}", "  whole ", "a### 回答:b### 回答: c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in df.select(extract_answer(F.col("t"), ANSWER_MARKER)).collect()]
    assert out == ["y", "z", "whole", "c"]


def test_array_functions(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b", "a"], [1, 2, 3, 4, 5])], "x array<string>, y array<string>, z array<int>")
    row = df.select(
        array_intersection(F.col("x"), F.col("y")).alias("i"),
        chunk_array(F.col("z"), 2).alias("c"),
        chunk_array(F.slice("z", 1, 0), 2).alias("e"),
    ).first()
    assert row.i == ["a", "a", "b"]
    assert row.c == [[1, 2], [3, 4], [5]]
    assert row.e == []


def test_intersection_of_long_lists_is_not_quadratic(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(9))], [rng.choice("abcdxy") for _ in range(rng.randrange(6))]) for _ in range(60)]
    rows += [([f"w{i % 70_000}" for i in range(200_000)], [f"w{i}" for i in range(0, 140_000, 2)]), ([None, "a"], [None, "a"]), (None, ["a"]), (["a"], None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x array<string>, y array<string>")
    began = time.time()
    got = {r.id: r.i for r in df.select("id", array_intersection(F.col("x"), F.col("y")).alias("i")).collect()}
    assert time.time() - began < 60  # item by item this is 14 billion comparisons
    for i, (x, y) in enumerate(rows):
        assert got[i] == (None if x is None or y is None else [v for v in x if v is not None and v in set(y)]) if i != 60 else True
    known = set(rows[60][1])
    assert got[60] == [v for v in rows[60][0] if v in known]
