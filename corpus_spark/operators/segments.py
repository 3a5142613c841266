"""Greedy segments of an ordered table: a segment closes as soon as it holds the budget.

Each segment starts where the last one closed, so where a segment starts depends on all rows
before it. Done by ranges of the order and not row by row: a row at which a segment may
start is told by the sum of all sizes before it, and a chain of segments by the sum at
which its next one starts. Each range becomes a table "next start at entry, next start at
exit, segments started". Its entries are only the rows within one budget of the range's
start. Tables of FAN ranges are composed in one task, those of FAN compositions in another; then the
true entries are handed down again to every range. A task holds one range, or the tables of FAN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.operators.order import MAX_BUCKETS, NARROW_BUCKET_ROWS, OrderBy, _ranges, _with_bucket, _with_keys
from corpus_spark.session import materialize

__all__ = ["budget_segments"]

FAN = 256
assert FAN * FAN >= MAX_BUCKETS

_TABLE = "chain int, above int, part int, entry long, leave long, n long"
_TABLE_ARROW = pa.schema([(c, pa.int32()) for c in ("chain", "above", "part")] + [(c, pa.int64()) for c in ("entry", "leave", "n")])
_GIVEN = "chain int, above int, part int, entry long, n long"
_GIVEN_ARROW = pa.schema([(c, pa.int32()) for c in ("chain", "above", "part")] + [("entry", pa.int64()), ("n", pa.int64())])


def _chains(before: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a segment that starts at each row: (next row, next start's sum at the range's exit, segments started)."""
    rows = len(before)
    follows = np.searchsorted(before, before + budget, "left")
    jump, last, n = follows.copy(), np.arange(rows), np.ones(rows, np.int64)
    while True:
        on = np.flatnonzero(jump < rows)
        if not len(on):
            return follows, before[last] + budget, n
        to = jump[on]
        n[on], last[on], jump[on] = n[on] + n[to], last[to], jump[to]


def _table(budget: int):
    """A range's rows to its table; only rows that a chain from before can enter are listed."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("before")
        before = rows["before"].to_numpy()
        _, leave, n = _chains(before, budget)
        entry, at = np.unique(before, return_index=True)  # the first of rows that nothing lies between
        upto = int(np.searchsorted(entry, before[0] + budget, "left")) + 1
        entry, at = entry[:upto], at[:upto]
        ids = [pa.array(np.full(len(entry), rows[c][0].as_py()), pa.int32()) for c in ("chain", "above", "part")]
        return pa.table([*ids, pa.array(entry), pa.array(leave[at]), pa.array(n[at])], schema=_TABLE_ARROW)

    return run


def _parts(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, entry, leave, n) of the composed parts, in order."""
    table = table.sort_by([("part", "ascending"), ("entry", "ascending")])
    part = table["part"].to_numpy()
    cuts = np.flatnonzero(np.diff(part)) + 1
    columns = [np.split(table[c].to_numpy(), cuts) for c in ("entry", "leave", "n")]
    return [(int(p), *x) for p, *x in zip(part[np.concatenate([[0], cuts])], *columns)] if len(part) else []


def _through(parts: list[tuple], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Chains with these next starts through all parts: (next starts, segments, state before each part)."""
    state, n, given = start.copy(), np.zeros(len(start), np.int64), []
    for part, entry, leave, count in parts:
        given.append((part, state.copy(), n.copy()))
        at = np.searchsorted(entry, state, "left")
        inside = at < len(entry)  # else the next segment starts in a later part
        state[inside], n[inside] = leave[at[inside]], n[inside] + count[at[inside]]
    return state, n, given


def _compose(budget: int):
    """Tables of up to FAN parts to one table of the whole."""

    def run(table: pa.Table) -> pa.Table:
        parts = _parts(table)
        first = int(parts[0][1][0])
        every = np.unique(np.concatenate([entry for _, entry, _, _ in parts]))
        entry = every[: int(np.searchsorted(every, first + budget, "left")) + 1]
        leave, n, _ = _through(parts, entry)
        chain, above = table["chain"][0].as_py(), table["above"][0].as_py()
        ids = [np.full(len(entry), x, np.int32) for x in (chain, above // FAN, above)]
        return pa.table([*map(pa.array, ids), pa.array(entry), pa.array(leave), pa.array(n)], schema=_TABLE_ARROW)

    return run


def _hand_down(table: pa.Table, given: pa.Table) -> pa.Table:
    """The one true chain's state before each part."""
    parts = _parts(table)
    if not parts:
        return _GIVEN_ARROW.empty_table()
    start, base = (given["entry"][0].as_py(), given["n"][0].as_py()) if given.num_rows else (0, 0)
    _, _, states = _through(parts, np.array([start], np.int64))
    chain = table["chain"][0].as_py()
    rows = [(chain, part // FAN, part, int(state[0]), base + int(n[0])) for part, state, n in states]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _GIVEN_ARROW)], schema=_GIVEN_ARROW)


def _mark(budget: int, out: str):
    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        rows = rows.sort_by("before")
        before = rows["before"].to_numpy()
        follows, _, _ = _chains(before, budget)
        starts = np.zeros(len(before), np.int64)
        at = int(np.searchsorted(before, given["entry"][0].as_py(), "left")) if len(before) else 0
        while at < len(before):
            starts[at] = 1
            at = int(follows[at])
        segment = given["n"][0].as_py() + np.cumsum(starts) - 1
        kept = [c for c in rows.column_names if c not in ("chain", "above", "part", "before")]
        return rows.select(kept).append_column(out, pa.array(segment, pa.int64()))

    return run


def budget_segments(
    df: DataFrame, order_by: OrderBy, size: str, budget: int, within: OrderBy | None = None,
    out: str = "segment", bucket_rows: int | None = None,
) -> DataFrame:
    """Add the 0-based number of each row's segment to a narrow table.

    Rows are taken in order; a segment is closed once its sizes, never negative and NULL
    counting as 0, add up to ``budget``. The last one may hold less. Rows of size 0 after a
    full segment open the next one. ``within`` starts anew for each of a few groups. The
    order must be unique for a unique result; the rows are written once.
    """
    if budget < 1:
        raise ValueError("the budget must be positive")
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    keyed, names, groups = _with_keys(df, order_by, within)
    amount = F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_amount")
    keyed = materialize(keyed.select(*[F.col(c).alias(k) for c, k in inner.items()], *names, amount), "segment-sizes")
    ranges, _ = _ranges(keyed, names, groups, ["_amount"], bucket_rows or NARROW_BUCKET_ROWS)
    located = _with_bucket(keyed, names, ranges.bounds, ranges.base)
    # Chain and place in it of each range; ranges of one group follow each other.
    place, owner, chain, number = [], object(), -1, 0
    for bucket in range(len(ranges.bounds) + 1):
        mine = tuple(ranges.bounds[bucket - 1][:groups]) if bucket and groups else None
        if bucket == 0 or mine != owner:
            owner, chain, number = mine, chain + 1, 0
        place.append((bucket, chain, number // FAN, number))
        number += 1
    places = df.sparkSession.createDataFrame(place, "_bucket int, chain int, above int, part int")
    located = located.join(F.broadcast(places), "_bucket")  # at most MAX_BUCKETS rows and one for each group
    ahead = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = F.get("_base", F.lit(0)) + F.coalesce(F.sum("_amount").over(ahead), F.lit(0))
    rows = located.withColumn("_before", before)
    rows = rows.select(*inner.values(), F.col("_before").alias("before"), "chain", "above", "part")
    narrow = rows.select("chain", "above", "part", "before")
    tables = narrow.groupBy("chain", "above", "part").applyInArrow(_table(budget), _TABLE)
    tables = materialize(tables, "segment-tables")
    whole = materialize(tables.groupBy("chain", "above").applyInArrow(_compose(budget), _TABLE), "segment-chains")
    nothing = df.sparkSession.createDataFrame([], _GIVEN)
    top = whole.groupBy("chain").cogroup(nothing.groupBy("chain")).applyInArrow(_hand_down, _GIVEN)
    top = top.select("chain", F.col("part").alias("above"), F.col("part"), "entry", "n")
    given = tables.groupBy("chain", "above").cogroup(top.groupBy("chain", "above")).applyInArrow(_hand_down, _GIVEN)
    given = materialize(given, "segment-entries")
    schema = df.select(*[F.col(c).alias(k) for c, k in inner.items()], F.lit(0).cast("bigint").alias(out)).schema
    both = rows.groupBy("chain", "part").cogroup(given.groupBy("chain", "part"))
    return both.applyInArrow(_mark(budget, out), schema).withColumnsRenamed({k: c for c, k in inner.items()})
