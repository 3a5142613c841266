"""Chat formatting: link tool calls to results, order them, check arguments, write canonical JSON.

Calls and results meet in a hash join on conversation and identifier, so one long
conversation spreads over all tasks. The first result at or after the call answers it;
further ones and results without a call come out as rows of their own, one for each
different (position, result) with the number of its copies.

The order within a conversation is (level, position): the level of a call is the number of
calls on the longest chain of dependencies before it, NULL on or behind a cycle. A
conversation with at most TASK_EDGES different dependencies is ordered inside one task from
its narrow table of them; a larger one is peeled level by level with joins.

Arguments are checked against the tool's schema {field: (type, required)} and each call is
written with sorted keys, no spaces and characters unescaped.

Rows: NULL identifiers link with nothing. NULL or malformed arguments and unknown tools
are invalid; an empty text is a value. Malformed is also what JSON cannot say again (NaN,
numbers beyond a double) and what is nested too deeply to read; halves of surrogate pairs
stay escaped. A repeated call is answered each time; a NULL position comes first.
Dependencies on unknown calls are ignored, but counted. Results have no level, position is
their own. Other columns do not matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Hashable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.session import materialize

Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


TASK_EDGES = 50_000
BUCKET_EDGES, LEAST_BUCKETS = 5_000, 64
_SURROGATE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Text that UTF-8 can hold: halves of surrogate pairs as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return _escaped(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")))


def _no_json(name: str) -> None:
    raise ValueError(name)


def parse_arguments(raw: str | None) -> object:
    """The value of a JSON text that can be written again, else None."""
    try:
        value = None if raw is None else json.loads(raw, parse_constant=_no_json)
        canonical(value)
    except (ValueError, RecursionError):
        return None
    return value


def argument_errors(name: str | None, arguments: object, schemas: Schemas) -> list[str]:
    """What is wrong with the arguments of a call, in order of the fields."""
    if name not in schemas:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["no object"]
    errors = []
    for field, (kind, required) in sorted(schemas[name].items()):
        value = arguments.get(field)
        if value is None:
            errors += [f"{field} missing"] if required else []
        elif not isinstance(value, _KINDS[kind]) or (isinstance(value, bool) and kind != "boolean"):
            errors.append(f"{field} not {kind}")
    return errors + [f"{field} unknown" for field in sorted(set(arguments) - set(schemas[name]))]


def chain_levels(needs: Mapping[Hashable, set]) -> dict[Hashable, int | None]:
    """Calls before each call on its longest chain of dependencies; None on or behind a cycle."""
    waiting = {call: len(before) for call, before in needs.items()}
    after: dict[Hashable, list] = {}
    for call, before in needs.items():
        for other in before:
            after.setdefault(other, []).append(call)
    levels: dict[Hashable, int | None] = dict.fromkeys(needs)
    last, level = [call for call in after if call not in needs], 0
    while last:
        level, done, last = level + 1, last, []
        for other in done:
            for call in after.get(other, ()):
                waiting[call] -= 1
                if not waiting[call]:
                    levels[call] = level
                    last.append(call)
    return levels


def _levels_in_task(edges: pd.DataFrame) -> pd.DataFrame:
    needs: dict[tuple, set[tuple]] = {}
    for conv, call, other in zip(*(edges[c].tolist() for c in ("conv_id", "call_id", "needs"))):
        needs.setdefault((conv, call), set()).add((conv, other))
    levels = chain_levels(needs)
    out = pd.DataFrame({"conv_id": [k[0] for k in levels], "call_id": [k[1] for k in levels]})
    return out.assign(level=pd.array(list(levels.values()), "Int32"))


def _peeled_levels(edges: DataFrame) -> DataFrame:
    """The same by joins: a call is placed one level behind the last of its dependencies."""
    keys = ["conv_id", "call_id"]
    waiting = materialize(edges, "dependencies")
    heads = waiting.select(*keys).distinct()
    others = waiting.select("conv_id", F.col("needs").alias("call_id")).distinct()
    last, level, placed = materialize(others.join(heads, keys, "left_anti"), "levels"), 0, None
    while not last.isEmpty():
        level += 1
        done = last.select("conv_id", F.col("call_id").alias("needs"))
        touched = waiting.join(done, ["conv_id", "needs"]).select(*keys).distinct()
        waiting = materialize(waiting.join(done, ["conv_id", "needs"], "left_anti"), "dependencies")
        last = materialize(touched.join(waiting.select(*keys).distinct(), keys, "left_anti"), "levels")
        here = last.withColumn("level", F.lit(level))
        placed = here if placed is None else placed.unionByName(here)
    cyclic = waiting.select(*keys).distinct().withColumn("level", F.lit(None).cast("int"))
    return cyclic if placed is None else placed.unionByName(cyclic)


def dependency_levels(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """(conv_id, call_id, level) of every call with known dependencies, from (conv_id, call_id, needs)."""
    edges = materialize(edges.select("conv_id", "call_id", "needs").distinct(), "dependencies")
    sizes = edges.groupBy("conv_id").count()
    large = materialize(sizes.where(F.col("count") > (task_edges or TASK_EDGES)).select("conv_id"), "large")
    schema = edges.select("conv_id", "call_id", F.lit(None).cast("int").alias("level")).schema
    # Whole conversations share a group, about BUCKET_EDGES dependencies each: most have only a few.
    buckets = max(LEAST_BUCKETS, edges.count() // BUCKET_EDGES)
    dealt = edges.join(large, "conv_id", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    small = dealt.groupBy("bucket").applyInPandas(_levels_in_task, schema)
    if large.isEmpty():
        return small
    return small.unionByName(_peeled_levels(edges.join(large, "conv_id", "left_semi")))


def _written(schemas: Schemas):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, texts = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result", "is_call", "linked")]
            for call_id, name, raw, result, is_call, linked in zip(*columns):
                if not is_call:
                    valid.append(None)
                    errors.append(None)
                    texts.append(canonical({"call_id": call_id, "result": result}))
                    continue
                arguments = parse_arguments(raw)
                found = argument_errors(name, arguments, schemas)
                valid.append(not found)
                errors.append(_escaped("; ".join(found)))
                message = {"arguments": arguments, "call_id": call_id, "name": name}
                texts.append(canonical({**message, "result": result} if linked else message))
            out = batch.drop_columns(["arguments", "result", "is_call"])
            yield pa.record_batch(
                [*out.columns, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())],
                [*out.schema.names, "valid", "errors", "json"],
            )

    return run


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result that answers none as the first.

    calls: conv_id, call_id, position, name, arguments (JSON), depends_on (array of call_id).
    results: conv_id, call_id, position, result. Returns conv_id, call_id, name, level,
    position, linked, n_results (for a result: its copies), n_unknown (dependencies), valid,
    errors, json. ``linked`` is true for a call with a result and for a further result of a call.
    """
    keys = ["conv_id", "call_id"]
    calls = materialize(calls.select(*keys, "position", "name", "arguments", "depends_on"), "calls")
    known = calls.where("call_id is not null").groupBy(*keys).agg(F.min("position").alias("at"))
    needs = calls.where("call_id is not null").select(*keys, F.explode(F.array_distinct("depends_on")).alias("needs"))
    found = known.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    edges = needs.join(found, ["conv_id", "needs"], "left")
    unknown = edges.where("there is null").groupBy(*keys).agg(F.countDistinct("needs").alias("n_unknown"))
    levels = dependency_levels(edges.where("there")).withColumn("ordered", F.lit(True))

    # Equal results are one row with their number before anything is linked.
    order = F.struct("position", "result")
    counted = results.groupBy(*keys, "position", "result").agg(F.count("*").alias("copies"))
    counted = materialize(counted.join(known.withColumn("called", F.lit(True)), keys, "left"), "results")
    answers = counted.where("called").groupBy(*keys).agg(
        F.sum("copies").alias("n_results"),
        F.min(F.when(F.col("position") >= F.coalesce("at", "position"), order)).alias("first"),
        F.min(order).alias("any"),
    )
    answers = answers.select(*keys, "n_results", F.coalesce("first", "any").alias("answer"))
    rows = calls.join(answers, keys, "left").join(unknown, keys, "left").join(levels, keys, "left").select(
        *keys, "name", F.when(F.col("ordered"), F.col("level")).otherwise(F.lit(0)).alias("level"), "position",
        F.col("answer").isNotNull().alias("linked"), F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.coalesce("n_unknown", F.lit(0)).cast("bigint").alias("n_unknown"),
        "arguments", F.col("answer.result").alias("result"), F.lit(True).alias("is_call"),
    )
    others = counted.join(answers, keys, "left").where(F.col("answer").isNull() | ~order.eqNullSafe(F.col("answer")))
    rows = rows.unionByName(others.select(
        *keys, F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), "position",
        F.coalesce("called", F.lit(False)).alias("linked"), F.col("copies").alias("n_results"), F.lit(0).cast("bigint").alias("n_unknown"),
        F.lit(None).cast("string").alias("arguments"), "result", F.lit(False).alias("is_call"),
    ))
    kept = [f for f in rows.schema.fields if f.name not in ("arguments", "result", "is_call")]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(_written(schemas), f"{names}, valid boolean, errors string, json string")


# --- the registered query ----------------------------------------------------

TURN_SCHEMAS: Schemas = {
    "reply": {"prompt": ("string", True), "turn": ("integer", True)},
    "configure": {"instruction": ("string", True)},
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chat turns as calls and results.

    A user's turn calls ``reply``, a system turn ``configure``; the assistant's next turn is
    the result, and a call depends on the two answered just before it.
    """
    def name(turn: Column) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))

    asked = turns.where("role <> 'assistant' or role is null")
    reply = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    configure = F.to_json(F.struct(F.col("text").alias("instruction")))
    calls = asked.select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"),
        F.when(F.col("role") == "user", F.lit("reply")).when(F.col("role") == "system", F.lit("configure")).alias("name"),
        F.when(F.col("role") == "system", configure).otherwise(reply).alias("arguments"),
        F.array(name(F.col("turn") - 2), name(F.col("turn") - 4)).alias("depends_on"),
    )
    answered = turns.where("role = 'assistant'")
    results = answered.select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("result")
    )
    return calls, results


def tool_call_sql(table: str = "conversations") -> str:
    """The registered query for conversations whose (conv_id, turn) are unique and not NULL."""
    return f"""
WITH RECURSIVE chains(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM {table} WHERE role <> 'assistant'
  UNION SELECT c.conv_id, n.turn, c.level + 1 FROM chains c JOIN {table} n
    ON n.conv_id = c.conv_id AND n.turn IN (c.turn + 2, c.turn + 4) AND n.role <> 'assistant'),
levels AS (SELECT conv_id, turn, max(level) AS level FROM chains GROUP BY ALL),
asked AS (SELECT * FROM {table} WHERE role <> 'assistant'),
answered AS (SELECT * FROM {table} WHERE role = 'assistant'),
joined AS (
  SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.turn, r.turn - 1) AS at, a.role, a.turn, a.text,
         r.turn AS r_turn, r.text AS result, a.conv_id IS NOT NULL AS is_call, r.conv_id IS NOT NULL AS has_result
  FROM asked a FULL JOIN answered r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1)
SELECT j.conv_id, j.conv_id || ':' || j.at AS call_id,
  CASE j.role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'configure' END AS name,
  l.level, coalesce(j.turn, j.r_turn) AS position, is_call AND has_result AS linked, has_result::BIGINT AS n_results,
  CASE WHEN is_call THEN (p.conv_id IS NULL)::BIGINT + (o.conv_id IS NULL)::BIGINT ELSE 0 END AS n_unknown,
  CASE WHEN is_call THEN j.text IS NOT NULL END AS valid,
  CASE WHEN is_call THEN CASE WHEN j.text IS NOT NULL THEN '' WHEN j.role = 'user' THEN 'prompt missing' ELSE 'instruction missing' END END AS errors,
  CASE WHEN is_call THEN
    '{{"arguments":{{' || CASE WHEN j.role = 'user'
      THEN CASE WHEN j.text IS NULL THEN '' ELSE '"prompt":' || to_json(j.text) || ',' END || '"turn":' || j.turn
      ELSE CASE WHEN j.text IS NULL THEN '' ELSE '"instruction":' || to_json(j.text) END END
    || '}},"call_id":' || to_json(j.conv_id || ':' || j.at) || ',"name":"' || CASE j.role WHEN 'user' THEN 'reply' ELSE 'configure' END || '"'
    || CASE WHEN has_result THEN ',"result":' || coalesce(to_json(j.result)::VARCHAR, 'null') ELSE '' END || '}}'
  ELSE '{{"call_id":' || to_json(j.conv_id || ':' || j.at) || ',"result":' || coalesce(to_json(j.result)::VARCHAR, 'null') || '}}' END AS json
FROM joined j LEFT JOIN levels l ON l.conv_id = j.conv_id AND l.turn = j.turn
LEFT JOIN asked p ON is_call AND p.conv_id = j.conv_id AND p.turn = j.turn - 2
LEFT JOIN asked o ON is_call AND o.conv_id = j.conv_id AND o.turn = j.turn - 4"""
