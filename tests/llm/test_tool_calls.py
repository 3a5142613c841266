"""Linking, order, validation and canonical JSON."""

import json
import random

import pytest

from corpus_spark.llm.tool_calls import argument_errors, dependency_levels, link_tool_calls

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}
CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, position long, result string"


def link(spark, calls, results):
    rows = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id): r for r in rows}, rows


def test_links_and_json(spark):
    ok = '{"b": 2.5, "a": 1, "note": "é\\n"}'
    calls = [(1, "x", 0, "add", ok, []), (1, "y", 1, "add", "{bad", ["x"]), (1, None, 2, "add", ok, None), (2, "x", 0, "mul", "{}", ["gone"])]
    results = [(1, "x", 3, "late"), (1, "x", 2, "first"), (1, "z", 4, "orphan"), (1, None, 5, None), (2, "x", -1, "early")]
    got, rows = link(spark, calls, results)
    assert len(rows) == 7
    x = next(r for r in rows if r.call_id == "x" and r.conv_id == 1 and r.valid)
    assert x.linked and x.n_results == 2 and x.valid and x.errors == ""
    assert x.json == '{"arguments":{"a":1,"b":2.5,"note":"é\\n"},"call_id":"x","name":"add","result":"first"}'
    assert got[1, "y"].errors == "no object" and not got[1, "y"].linked
    assert got[1, "z"].valid is None and json.loads(got[1, "z"].json) == {"call_id": "z", "result": "orphan"}
    assert got[2, "x"].errors == "unknown tool" and got[2, "x"].n_unknown == 1 and got[2, "x"].linked
    assert sum(r.call_id is None for r in rows) == 2
    late = next(r for r in rows if "late" in r.json)
    assert late.linked and late.n_results == 1 and late.valid is None and late.level is None and late.position == 3


def test_order_follows_dependencies(spark):
    calls = [(1, c, p, "add", "{}", d) for c, p, d in (("a", 3, []), ("b", 1, ["a"]), ("c", 2, ["b", "a"]), ("d", 0, ["e"]), ("e", 4, ["d"]), ("f", 9, ["e"]))]
    calls += [(2, c, p, "add", "{}", d) for c, p, d in (("a", 0, []), ("b", 1, ["a"]))]
    got, _ = link(spark, calls, [])
    assert [got[1, c].level for c in "abcdef"] == [0, 1, 2, None, None, None]
    assert [got[2, c].level for c in "ab"] == [0, 1]


def test_repeated_calls_and_empty_tables(spark):
    call = (1, "x", 0, "add", "{}", [])
    _, rows = link(spark, [call, call], [(1, "x", 1, "r"), (1, "x", 1, "r")])
    assert len(rows) == 2 and all(r.linked and r.n_results == 2 for r in rows)
    assert link(spark, [], [])[1] == []


@pytest.mark.parametrize(
    "arguments, errors",
    [({"a": 1, "b": 1}, []), ({"a": True, "b": 1}, ["a not integer"]), ({"b": "1", "c": 0}, ["a missing", "b not number", "c unknown"]), ([], ["no object"]), (None, ["no object"])],
)
def test_validation(arguments, errors):
    assert argument_errors("add", arguments, SCHEMAS) == errors


def test_levels_are_longest_chains_in_a_task_and_peeled(spark):
    rng = random.Random(3)
    edges = [(g, f"n{a}", f"n{rng.randrange(a)}") for g in range(4) for a in range(1, 40) for _ in range(rng.randint(0, 3))]
    edges += [(3, "n0", "n39"), (3, "n39", "n0")]  # a cycle
    frame = spark.createDataFrame(edges, "conv_id long, call_id string, needs string")
    wanted, needs = {}, {}
    for g, a, b in edges:
        needs.setdefault((g, a), set()).add((g, b))

    def longest(node, seen=()):
        if node in seen:
            return None
        below = [longest(n, (*seen, node)) for n in needs.get(node, ())]
        return None if None in below else max((b + 1 for b in below), default=0)

    wanted = {n: longest(n) for n in needs}
    for limit in (1, 60, 10**6):
        assert {(r.conv_id, r.call_id): r.level for r in dependency_levels(frame, limit).collect()} == wanted


@pytest.mark.parametrize("raw", ["[" * 100_000, '{"a": NaN, "b": 1}', '{"a": 1, "b": 1e999}', '{"a": ' + "9" * 5000 + "}"])
def test_what_json_cannot_write_again_is_malformed(spark, raw):
    (row,) = link(spark, [(1, "x", 0, "add", raw, [])], [])[1]
    assert not row.valid and row.errors == "no object" and json.loads(row.json)["arguments"] is None


def test_lone_surrogates_stay_escaped(spark):
    raw = '{"a": 1, "b": 2, "note": "\\ud800", "\\udc00": "\\ud83d\\ude00"}'
    (row,) = link(spark, [(1, "x", 0, "add", raw, [])], [])[1]
    assert "\\ud800" in row.json and "😀" in row.json and json.loads(row.json)["arguments"] == json.loads(raw)
    assert row.errors == "\\udc00 unknown"


def test_long_texts_and_clashing_columns(spark):
    text = json.dumps({"a": 1, "b": 2, "note": "é" * 2_000_000})
    calls = spark.createDataFrame([(1, "x", 0, "add", text, [])], CALLS).selectExpr("*", "1 as level", "2 as json", "3 as there", "4 as at")
    results = spark.createDataFrame([(1, "x", 1, "r" * 2_000_000)], RESULTS).selectExpr("*", "1 as linked", "2 as copies", "3 as answer")
    (row,) = link_tool_calls(calls, results, SCHEMAS).collect()
    assert row.linked and row.valid and len(row.json) > 4_000_000


def test_further_and_lost_results_come_out_once_for_each_text(spark):
    results = [(1, "x", 1, "r"), (1, "x", 1, "r"), (1, "x", 2, "s"), (1, "x", 2, "s"), (1, "z", 1, "o"), (1, "z", 2, "o"), (None, "x", 1, None)]
    _, rows = link(spark, [(1, "x", 0, "add", "{}", [])], results)
    got = sorted((r.call_id, r.position, r.linked, r.n_results, json.loads(r.json)["result"]) for r in rows if r.conv_id)
    assert got == [("x", 0, True, 4, "r"), ("x", 2, True, 2, "s"), ("z", 1, False, 1, "o"), ("z", 2, False, 1, "o")]
    assert len(rows) == 5
