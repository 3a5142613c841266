"""Positions, cut points, exact splits, balance and samples.

A DataFrame has no row order, so every positional operator takes ``order_by``:
ascending columns that together are unique. NULL comes first, as in any Spark sort.
Rows that the ordering cannot tell apart are an error where their order matters, at
any size. Nothing here sorts the
data in one task. A narrow table of the keys is written once; a hash sample of
it gives split points, exact counts between them give running totals, and a row
is numbered inside its own range.

``first n`` and ``split`` do not even move the rows: the keys at the cut points
are found on the narrow table and the rest is a predicate on each row. A cut
between equal keys is an error, never a wrong size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.constants import SHUFFLE_SEED
from corpus_spark.functions.arrays import bind
from corpus_spark.session import materialize

__all__ = [
    "shuffle_key",
    "positions",
    "exact_rank",
    "running_sums",
    "head_n",
    "sample_k",
    "split_counts",
    "split_labels",
    "split_exact",
    "split_by_sizes",
    "carve_validation",
    "take_per_group",
    "balance_two",
    "balance",
    "group_counts",
    "value_counts",
    "quantiles_of_counts",
    "exact_quantiles",
]

OrderBy = str | Column | Sequence[str | Column]

BUCKET_ROWS = 50_000
NARROW_BUCKET_ROWS = 500_000
MAX_BUCKETS = 65_536
SAMPLE_PER_BUCKET = 16
HEAVY_RANGE = 4  # times its usual rows: no even draw of SAMPLE_PER_BUCKET keys gets there
SORT_LIMIT = 32


def _columns(items: OrderBy | None) -> list[Column]:
    if items is None:
        return []
    items = [items] if isinstance(items, (str, Column)) else list(items)
    return [F.col(i) if isinstance(i, str) else i for i in items]


def shuffle_key(seed: int, *columns: str | Column) -> Column:
    """A reproducible pseudo-random sort key: md5 of seed and key."""
    parts = [c.cast("string") for c in _columns(columns)]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


# --- ranges of an ordering -------------------------------------------------


@dataclass
class _Ranges:
    """Split points of an ordering and the running totals in front of each range."""

    names: list[str]
    bounds: list[Row]
    base: list[list[int]]
    sizes: dict[int, int] = field(default_factory=dict)  # rows of each range, if rows were counted


def _with_keys(
    df: DataFrame, order_by: OrderBy, within: OrderBy | None
) -> tuple[DataFrame, list[str], int]:
    groups, keys = _columns(within), _columns(order_by)
    named = {f"_k{i}": c for i, c in enumerate(groups + keys)}
    return df.withColumns(named), list(named), len(groups)


def _bucket_total(rows: int, bucket_rows: int) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / bucket_rows)))


def _split_points(keys: DataFrame, names: list[str], groups: int, parts: int, rows: int) -> list[Row]:
    """At most ``parts`` sampled keys, plus the first key of every group.

    The sample holds about SAMPLE_PER_BUCKET different keys for each range and is sorted
    in tasks of about BUCKET_ROWS. It only decides how even the ranges are, never the result.
    """
    candidates = []
    if parts > 1:
        step = max(1, rows // (parts * SAMPLE_PER_BUCKET))
        sample = keys.where(F.pmod(F.xxhash64(*names), F.lit(step)) == 0).distinct()
        tasks = math.ceil(parts * SAMPLE_PER_BUCKET / BUCKET_ROWS)
        ordered = sample.repartitionByRange(tasks, *names).sortWithinPartitions(*names)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task
        numbered = ordered.withColumn("_r", place + 1)
        candidates.append(numbered.where(F.col("_r") % SAMPLE_PER_BUCKET == 0).select(*names))
    if groups:
        first = F.min(F.struct(*names)).alias("_first")
        starts = keys.groupBy(*names[:groups]).agg(first).select("_first.*")
        candidates.append(starts.select(*names))
    if not candidates:
        return []
    points = candidates[0]
    for other in candidates[1:]:
        points = points.unionByName(other)
    return points.distinct().orderBy(*names).collect()


def _with_bucket(
    df: DataFrame, names: list[str], bounds: list[Row], base: list[list[int]] | None = None
) -> DataFrame:
    """Add ``_bucket``, the number of bounds not above the row's key, and ``_base``.

    Two steps of about sqrt(bounds) comparisons each, inside the projection.
    """
    if not bounds:
        df = df.withColumn("_bucket", F.lit(0))
        if base is not None:
            df = df.withColumn("_base", F.array(*[F.lit(v).cast("bigint") for v in base[0]]))
        return df
    width = max(1, math.isqrt(len(bounds)))
    key_type = T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])
    fields = [
        T.StructField("coarse", T.ArrayType(key_type)),
        T.StructField("fine", T.ArrayType(key_type)),
        T.StructField("base", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
    fine = [tuple(b) for b in bounds]
    table = df.sparkSession.createDataFrame(
        [(fine[::width], fine, base or [])], T.StructType(fields)
    )
    row = table.select(F.struct("coarse", "fine", "base").alias("row")).scalar()
    key = F.struct(*[F.col(n) for n in names])

    def placed(points: Column) -> Column:
        coarse = F.size(F.filter(points["coarse"], lambda b: b <= key))

        def refined(start: Column) -> Column:
            near = F.slice(points["fine"], start + 1, F.lit(width))
            return start + F.size(F.filter(near, lambda b: b <= key))

        bucket = bind(F.greatest(coarse - 1, F.lit(0)) * width, refined)
        if base is None:
            return bucket
        return bind(bucket, lambda n: F.struct(n.alias("bucket"), F.get(points["base"], n).alias("base")))

    # One expression uses the points and nothing passes them on, so that they are inlined: as
    # a column of a projection all of them would be copied into every row.
    df = df.withColumn("_points", row).withColumn("_place", bind(F.col("_points"), placed)).drop("_points")
    if base is None:
        return df.withColumnRenamed("_place", "_bucket")
    return df.withColumns({"_bucket": F.col("_place.bucket"), "_base": F.col("_place.base")}).drop("_place")


def _ranges(
    keys: DataFrame, names: list[str], groups: int, values: list[str] | None, bucket_rows: int
) -> tuple[_Ranges, int]:
    """Ranges with running totals of ``values`` (of the rows if None), and the row count."""
    rows = keys.count()
    parts = _bucket_total(rows, bucket_rows)
    bounds = _split_points(keys, names, groups, parts, rows)
    zero = [0] * len(values or [None])
    base = [zero] * (len(bounds) + 1)
    if bounds:
        sums = [F.count("*")] if values is None else [F.sum(v) for v in values]
        totals = {
            r[0]: [int(v) for v in r[1:]]
            for r in _with_bucket(keys, names, bounds).groupBy("_bucket").agg(*sums).collect()
        }
        running, group = zero, None
        for bucket in range(len(bounds) + 1):
            owner = tuple(bounds[bucket - 1][:groups]) if bucket and groups else None
            if owner != group:
                running, group = zero, owner
            base[bucket] = running
            running = [a + b for a, b in zip(running, totals.get(bucket, zero))]
    sizes = {b: t[0] for b, t in totals.items()} if bounds and values is None else {}
    return _Ranges(names, bounds, base, sizes), rows


def _refuse_heavy_keys(keys: DataFrame, ranges: _Ranges, rows: int) -> None:
    """Fail on a key that repeats so often that one task would sort its range alone.

    Different keys fill their ranges evenly; only the ranges that they do not are looked at.
    """
    usual = max(NARROW_BUCKET_ROWS, rows // (len(ranges.bounds) + 1))
    heavy = sorted(b for b, n in ranges.sizes.items() if n > HEAVY_RANGE * usual)
    if not heavy:
        return
    near = _with_bucket(keys, ranges.names, ranges.bounds).where(F.col("_bucket").isin(heavy))
    again = near.groupBy(*ranges.names).count().where("count > 1").select("count").first()
    if again is not None:
        raise ValueError(f"order_by is not unique: a key is there {again[0]} times, add a key column")


def _numbered(df: DataFrame, ranges: _Ranges, name: str, flag_ties: bool = False) -> DataFrame:
    """Add the 0-based position; moves each row once, to its range.

    ``flag_ties`` adds ``_tie``, true where the row before has the same key.
    """
    located = _with_bucket(df, ranges.names, ranges.bounds, ranges.base)
    window = Window.partitionBy("_bucket").orderBy(*ranges.names)
    position = F.get("_base", F.lit(0)) + F.row_number().over(window) - 1
    added = {name: position.cast("bigint")}
    if flag_ties:
        key = F.struct(*ranges.names)
        added["_tie"] = F.coalesce(F.lag(key).over(window) == key, F.lit(False))
    return located.withColumns(added).drop("_base")


def _without_ties(rows: list[Row]) -> list[Row]:
    """Fail where a cut falls between rows that the ordering cannot tell apart."""
    for row in rows:
        if row["_tie"]:
            raise ValueError(f"order_by is not unique around position {row['_pos']}: add a key column")
    return rows


def positions(
    df: DataFrame,
    order_by: OrderBy,
    within: OrderBy | None = None,
    align: int = 1,
    name: str = "pos",
    keep_bucket: bool = False,
    bucket_rows: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Add the exact 0-based position of every row, optionally per group.

    ``written`` says that ``df`` is a stored table, whose keys need no copy.
    ``within`` names a column of few values, such as the split; its groups may
    be of any size. With ``align`` no batch of that many rows crosses a range,
    so a later grouping by (``_bucket``, batch) needs no further shuffle.
    """
    keyed, names, groups = _with_keys(df, order_by, within)
    keys = keyed.select(*names) if written else materialize(keyed.select(*names), "keys")
    ranges, rows = _ranges(keys, names, groups, None, NARROW_BUCKET_ROWS)
    _refuse_heavy_keys(keys, ranges, rows)
    parts = _bucket_total(rows, bucket_rows or BUCKET_ROWS)
    if parts > 1 or rows > NARROW_BUCKET_ROWS:
        # Even ranges for the wide rows start at every stride-th position.
        stride = align * math.ceil(rows / parts / align)
        starts = _numbered(keys, ranges, "_pos", flag_ties=True).where(F.col("_pos") % stride == 0)
        found = _without_ties(starts.orderBy(*names).select(*names, "_pos", "_tie").collect())
        bounds = [Row(*r[:-2]) for r in found]
        ranges = _Ranges(names, bounds, [[0]] + [[r["_pos"]] for r in found])
    numbered = _numbered(keyed, ranges, name, flag_ties=True)
    tied = F.raise_error(F.concat(F.lit("order_by is not unique around position "), F.col(name).cast("string")))
    numbered = numbered.withColumn(name, F.when(F.col("_tie"), tied.cast("bigint")).otherwise(F.col(name)))
    numbered = numbered.drop("_tie", *names)
    return numbered if keep_bucket else numbered.drop("_bucket")


def exact_rank(
    df: DataFrame,
    order_by: OrderBy,
    within: OrderBy | None = None,
    name: str = "rank",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Global ``row_number`` (1-based) without a single-task sort."""
    ranked = positions(df, order_by, within, name=name, bucket_rows=bucket_rows)
    return ranked.withColumn(name, F.col(name) + 1)


def running_sums(
    df: DataFrame,
    order_by: OrderBy,
    values: Sequence[str],
    suffix: str = "_cum",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Inclusive running totals of integer columns in key order.

    Meant for tables that are already aggregated to one narrow row per key.
    """
    values = list(values)
    keyed, names, _ = _with_keys(df, order_by, None)
    keyed = materialize(keyed, "running")
    ranges, _ = _ranges(keyed, names, 0, values, bucket_rows or NARROW_BUCKET_ROWS)
    located = _with_bucket(keyed, names, ranges.bounds, ranges.base)
    window = (
        Window.partitionBy("_bucket")
        .orderBy(*names)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = {
        f"{v}{suffix}": (F.get("_base", F.lit(i)) + F.sum(v).over(window)).cast("bigint")
        for i, v in enumerate(values)
    }
    return located.withColumns(totals).drop("_base", "_bucket", *names)


# --- cut points ------------------------------------------------------------


def _keys_at(keys: DataFrame, names: list[str], wanted: Sequence[int], bucket_rows: int | None) -> dict[int, Row]:
    """The keys at the wanted 0-based positions of a narrow key table."""
    wanted = sorted(set(wanted))
    if not wanted:
        return {}
    ranges, _ = _ranges(keys, names, 0, None, bucket_rows or NARROW_BUCKET_ROWS)
    first = [b[0] for b in ranges.base]
    needed = {max(i for i, start in enumerate(first) if start <= p) for p in wanted}
    near = _with_bucket(keys, names, ranges.bounds, ranges.base).where(F.col("_bucket").isin(sorted(needed)))
    # Equal keys are counted before they move: one row each, however often a key repeats.
    counted = near.groupBy("_bucket", *names).agg(F.min(F.get("_base", F.lit(0))).alias("_start"), F.count("*").alias("_n"))
    upto = Window.partitionBy("_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(upto))
    first, end = F.col("_end") - F.col("_n"), F.col("_end")
    places = F.array(*[F.lit(p).cast("bigint") for p in wanted])
    hits = ends.select(*names, first.alias("_first"), F.filter(places, lambda p: (p >= first) & (p < end)).alias("_hits"))
    found = {}
    for r in hits.where(F.size("_hits") > 0).collect():
        for p in r["_hits"]:
            if p > r["_first"]:
                raise ValueError(f"order_by is not unique around position {p}: add a key column")
            found[p] = Row(*[r[n] for n in names])
    return found


def _before(columns: list[Column], cut: Row, types: list[T.DataType]) -> Column:
    """True for rows whose key sorts before the cut; NULL sorts first."""
    literals = [F.lit(v).cast(t) for v, t in zip(cut, types)]
    result = F.lit(False)
    for column, literal, value in list(zip(columns, literals, cut))[::-1]:
        if value is None:
            result = column.isNull() & result
        else:
            result = column.isNull() | (column < literal) | ((column == literal) & result)
            result = F.coalesce(result, F.lit(False))
    return result


def _before_columns(columns: list[Column], cuts: list[Column]) -> Column:
    """The same for cuts that are columns."""
    result = F.lit(False)
    for column, cut in list(zip(columns, cuts))[::-1]:
        less = cut.isNotNull() & (column.isNull() | F.coalesce(column < cut, F.lit(False)))
        result = less | (column.eqNullSafe(cut) & result)
    return result


def _key_table(
    df: DataFrame, order_by: OrderBy, extra: Sequence[str] = (), written: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """The narrow key table of ``df``, taken from ``written`` where that exists."""
    columns = _columns(order_by)
    names = [f"_k{i}" for i in range(len(columns))]
    source = df if written is None else written
    table = source.select(*extra, *[c.alias(n) for c, n in zip(columns, names)])
    return (materialize(table, "keys") if written is None else table), names


def head_n(
    df: DataFrame,
    n: int,
    order_by: OrderBy,
    strict: bool = False,
    bucket_rows: int | None = None,
) -> DataFrame:
    """The first ``n`` rows in order; ``strict`` fails when there are fewer.

    A handful of rows is a top-n; more become a predicate on the key at
    position ``n``, so that no task collects wide rows.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if strict:
        rows = df.count()
        if n > rows:
            raise ValueError(f"{n} rows wanted, {rows} present")
    columns = _columns(order_by)
    if n <= SORT_LIMIT:
        top = df.select(F.struct(*columns).alias("k")).orderBy("k").limit(n + 1).collect()
        if n and len(top) > n and top[n] == top[n - 1]:
            raise ValueError(f"order_by is not unique around position {n}: add a key column")
        return df.orderBy(*columns).limit(n)
    keys, names = _key_table(df, order_by)
    cut = _keys_at(keys, names, [n], bucket_rows).get(n)
    if cut is None:
        return df
    return df.where(_before(columns, cut, [keys.schema[c].dataType for c in names]))


def sample_k(df: DataFrame, k: int, seed: int, key: str | Sequence[str]) -> DataFrame:
    """A reproducible random sample of exactly ``k`` rows."""
    key = [key] if isinstance(key, str) else list(key)
    return head_n(df, k, [shuffle_key(seed, *key), *key])


def split_counts(rows: int, held: float = 0.2, test_share: float = 0.5) -> list[tuple[str, int]]:
    """Sizes of train, validation and test: held-out parts are rounded up."""
    held_out = math.ceil(held * rows)
    test = math.ceil(test_share * held_out)
    return [("train", rows - held_out), ("validation", held_out - test), ("test", test)]


def split_labels(
    df: DataFrame,
    order_by: OrderBy,
    sizes: Callable[[int], Sequence[tuple[str, int]]],
    keys: DataFrame | None = None,
    bucket_rows: int | None = None,
) -> Column:
    """A column that names consecutive stretches of an ordering.

    The last stretch takes the rest. ``keys`` may pass a table with the key
    columns that is already narrow and written; the result fits both tables.
    """
    columns = _columns(order_by)
    table, names = _key_table(df, order_by, written=keys)
    plan = list(sizes(table.count()))
    ends, total = [], 0
    for _, size in plan[:-1]:
        total += size
        ends.append(total)
    cuts = _keys_at(table, names, ends, bucket_rows)
    types = [table.schema[n].dataType for n in names]
    label = F.lit(plan[-1][0])
    for (part, _), end in reversed(list(zip(plan[:-1], ends))):
        if end in cuts:
            label = F.when(_before(columns, cuts[end], types), F.lit(part)).otherwise(label)
        else:
            label = F.lit(part)
    return label


def split_by_sizes(
    df: DataFrame,
    order_by: OrderBy,
    sizes: Callable[[int], Sequence[tuple[str, int]]],
    name: str = "split",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add the names of ``split_labels`` as a column."""
    return df.withColumn(name, split_labels(df, order_by, sizes, bucket_rows=bucket_rows))


def split_exact(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int = SHUFFLE_SEED,
    held: float = 0.2,
    test_share: float = 0.5,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add ``split`` with the exact sizes of ``split_counts`` after a seeded shuffle."""
    key = [key] if isinstance(key, str) else list(key)
    return split_by_sizes(
        df,
        [shuffle_key(seed, *key), *key],
        lambda rows: split_counts(rows, held, test_share),
        bucket_rows=bucket_rows,
    )


def carve_validation(
    df: DataFrame, key: str | Sequence[str], percent: float, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Move a percentage of a table without validation rows into ``validation``."""
    key = [key] if isinstance(key, str) else list(key)

    def sizes(rows: int) -> list[tuple[str, int]]:
        held = math.floor(rows * percent / 100 + 0.5)
        return [("validation", held), ("train", rows - held)]

    return split_by_sizes(df, [shuffle_key(seed, *key), *key], sizes)


def group_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def take_per_group(
    df: DataFrame,
    group: str,
    quotas: Mapping[object, int],
    order_by: OrderBy,
    keys: DataFrame | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """The first rows of each named group in order; other groups stay whole.

    A group smaller than its quota is kept as it is.
    """
    columns = _columns(order_by)
    table, names = _key_table(df, order_by, [group], written=keys)
    wanted = [F.col(group).eqNullSafe(F.lit(value)) for value in quotas]
    named = table.where(reduce(or_, wanted, F.lit(False)))
    present = {r[0]: r[1] for r in group_counts(named, group).collect()}
    types = [table.schema[n].dataType for n in names]
    kept = F.lit(True)
    for value, quota in quotas.items():
        if present.get(value, 0) <= quota:
            continue
        members = table.where(F.col(group).eqNullSafe(F.lit(value)))
        cut = _keys_at(members, names, [quota], bucket_rows)[quota]
        kept = kept & (~F.col(group).eqNullSafe(F.lit(value)) | _before(columns, cut, types))
    return df.where(kept)


def balance_two(
    first: DataFrame, second: DataFrame, order_by: OrderBy, zoom: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Cut the larger of two tables in order.

    A smaller first table allows ``zoom`` times its size in the second; else the
    first is cut to the size of the second. Quotas beyond a table are clamped.
    """
    first_rows, second_rows = first.count(), second.count()
    if first_rows < second_rows:
        return first, head_n(second, min(first_rows * zoom, second_rows), order_by)
    return head_n(first, second_rows, order_by), second


def balance(
    df: DataFrame, label: str, order_by: OrderBy, ratio: float = 1.0
) -> DataFrame:
    """Cut every class, NULL included, to ``ratio`` times the size of the smallest class.

    The key at the cut of each class comes from one ranking of the narrow key table and
    is joined to the rows, so the number of jobs does not depend on the classes.
    """
    columns = _columns(order_by)
    keys, names = _key_table(df, order_by, [label])
    keys = keys.withColumnsRenamed({n: f"_at{n}" for n in names})  # positions has names of its own
    names = [f"_at{n}" for n in names]
    counts = group_counts(keys, label)
    quota = math.floor((counts.agg(F.min("n")).first()[0] or 0) * ratio)
    placed = positions(keys, [label, *names], name="_pos", written=True)
    starts = placed.groupBy(label).agg(F.min("_pos").alias("_start")).withColumnRenamed(label, "_class")
    ranked = placed.join(starts, F.col(label).eqNullSafe(F.col("_class")))
    cuts = ranked.where(F.col("_pos") - F.col("_start") == quota)
    cuts = cuts.select("_class", F.struct(*names).alias("_cut"))
    joined = df.join(cuts, F.col(label).eqNullSafe(F.col("_class")), "left")
    kept = F.col("_cut").isNull() | _before_columns(columns, [F.col(f"_cut.{n}") for n in names])
    return joined.where(kept).select(*df.columns)


# --- order statistics ------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Written rows (column, value, n) of the non-NULL values, in one pass.

    Equal values are combined before they move.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]
    counts = (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .where(F.col("c.value").isNotNull())
        .groupBy("c.column", "c.value")
        .agg(F.count("*").alias("n"))
    )
    return materialize(counts, "counts")


def quantiles_of_counts(
    counts: DataFrame, quantiles: Sequence[float], bucket_rows: int | None = None
) -> DataFrame:
    """Exact quantiles, interpolated, of a table (value, n): rows (quantile, value)."""
    running = materialize(
        running_sums(counts.select("value", "n"), "value", ["n"], bucket_rows=bucket_rows), "counts"
    )
    rows = running.agg(F.max("n_cum")).first()[0] or 0
    if rows == 0:
        return counts.sparkSession.createDataFrame([], "quantile double, value double")
    targets = []
    for q in quantiles:
        place = q * (rows - 1)
        low = math.floor(place)
        targets.append(
            F.struct(
                F.lit(float(q)).alias("quantile"),
                F.lit(low).cast("bigint").alias("lo"),
                F.lit(math.ceil(place)).cast("bigint").alias("hi"),
                F.lit(place - low).alias("part"),
            )
        )
    before = F.col("n_cum") - F.col("n")
    hits = running.select(
        "value",
        F.explode(
            F.filter(
                F.array(*targets), lambda t: (t["hi"] >= before) & (t["lo"] < F.col("n_cum"))
            )
        ).alias("t"),
    )
    low, high = F.min("value"), F.max("value")
    return hits.groupBy("t.quantile", "t.part").agg(
        (low + (high - low) * F.col("part")).alias("value")
    ).select("quantile", "value")


def exact_quantiles(
    df: DataFrame, column: str, quantiles: Sequence[float], bucket_rows: int | None = None
) -> DataFrame:
    """Exact quantiles of a numeric column with linear interpolation."""
    return quantiles_of_counts(value_counts(df, [column]), quantiles, bucket_rows)
