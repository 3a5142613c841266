"""Fixed blocks, batches and padding.

Positions place every row in a range that holds whole batches. All later
groupings keep that range as a key, so a row is moved once. A row is cut into
the blocks it overlaps before grouping: what is collected per group is at most
one block or one batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.constants import IGNORE_INDEX, MAP_BATCH_ROWS, MAX_DEFAULT_BLOCK
from corpus_spark.functions.arrays import attention_mask, bind, pad_array
from corpus_spark.operators.order import OrderBy, positions, shuffle_key
from corpus_spark.operators.segments import budget_segments

__all__ = [
    "resolve_block_size",
    "pack_blocks",
    "pack_wrapped",
    "pack_constant",
    "pack_budget",
    "assemble_batches",
    "pad_columns",
    "pad_batches",
    "collate_ragged",
]


# Rows here hold whole documents, so ranges are shorter than for narrow tables.
BUCKET_ROWS = 1_000


def resolve_block_size(block_size: int | None, model_max: int) -> int:
    """The wanted block, at most the model's; by default the model's up to 1024."""
    if block_size is None:
        return min(model_max, MAX_DEFAULT_BLOCK)
    return min(block_size, model_max)


def _placed(
    df: DataFrame, batch_rows: int, order_by: OrderBy, split: str | None, bucket_rows: int | None
) -> DataFrame:
    placed = positions(
        df, order_by, within=split, align=batch_rows, name="_pos",
        keep_bucket=True, bucket_rows=bucket_rows or BUCKET_ROWS,
    )
    return placed.withColumn("batch", F.expr(f"_pos div {batch_rows}"))


def _pack(
    placed: DataFrame,
    columns: Sequence[str],
    block: int,
    split: str | None,
    keep_short: bool,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Concatenate the arrays of each batch and cut them into blocks."""
    size = F.coalesce(F.size(columns[0]), F.lit(0))
    earlier = (
        Window.partitionBy("_bucket", "batch")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    located = placed.withColumn("_size", size.cast("bigint"))
    located = located.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    group = ([split] if split else []) + ["_bucket", "batch"]
    return _cut(located, columns, block, group, keep_short, carried).drop("_bucket")


def _cut(
    located: DataFrame, columns: Sequence[str], block: int, group: Sequence[str], keep_short: bool, carried: Sequence[str] = ()
) -> DataFrame:
    """Blocks of each group, whose arrays of ``_size`` items lie ``_start`` items from its start."""
    start, length = F.col("_start"), F.col("_size")
    blocks = F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + _size - 1) div {block}"))

    def piece(number: Column) -> Column:
        first = F.greatest(number * block - start, F.lit(0))
        last = F.least((number + 1) * block - start, length)
        return F.struct(
            number.alias("block"),
            (first + start).alias("at"),
            *[
                F.slice(F.col(c), (first + 1).cast("int"), (last - first).cast("int")).alias(c)
                for c in columns
            ],
        )

    pieces = located.where(length > 0).select(
        *group, *carried, F.explode(F.transform(blocks, piece)).alias("_piece")
    )
    packed = pieces.groupBy(*group, F.col("_piece.block").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("_piece.at", *[f"_piece.{c}" for c in columns]))).alias(
            "_pieces"
        ),
        *[F.max(c).alias(c) for c in carried],
    )

    packed = packed.select(
        *group, "block", *carried,
        *[F.flatten(f"_pieces.{c}").alias(c) for c in columns],
    )
    full = F.size(columns[0]) == block
    return packed.where(full | (F.col("block") == 0) if keep_short else full)


def pack_blocks(
    df: DataFrame,
    ids: str,
    block: int,
    order_by: OrderBy,
    batch_rows: int = MAP_BATCH_ROWS,
    split: str | None = None,
    others: Sequence[str] = (),
    keep_short: bool = True,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Concatenate ids per batch of rows and cut them into fixed blocks.

    A remainder is dropped, unless the whole batch is shorter than one block and
    ``keep_short`` is set. ``others`` are arrays of the same lengths. Returns
    (split, batch, block, ids, others, labels).
    """
    placed = _placed(df, batch_rows, order_by, split, bucket_rows)
    packed = _pack(placed, [ids, *others], block, split, keep_short)
    return packed.withColumn("labels", F.col(ids))


def pack_wrapped(
    df: DataFrame,
    ids: str,
    max_length: int,
    order_by: OrderBy,
    batch_rows: int = MAP_BATCH_ROWS,
    split: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Like ``pack_blocks`` for sequences with a first and a last marker.

    The markers are stripped before joining; every block is wrapped in those of
    the batch's first sequence.
    """
    placed = _placed(df, batch_rows, order_by, split, bucket_rows)
    running = (
        Window.partitionBy("_bucket", "batch")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = placed.withColumns(
        {
            "_first": F.first(F.get(F.col(ids), F.lit(0))).over(running),
            "_last": F.first(F.try_element_at(F.col(ids), F.lit(-1))).over(running),
        }
    )
    inner = F.slice(F.col(ids), 2, F.greatest(F.size(ids) - 2, F.lit(0)))
    packed = _pack(
        marked.withColumn(ids, inner), [ids], max_length - 2, split, True, ["_first", "_last"]
    )
    wrapped = F.concat(F.array("_first"), F.col(ids), F.array("_last"))
    return packed.withColumn(ids, wrapped).drop("_first", "_last")


def pack_constant(
    df: DataFrame,
    ids: str,
    seq_length: int,
    eos_id: int,
    order_by: OrderBy,
    batch_rows: int = MAP_BATCH_ROWS,
    split: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Join documents with an end marker after each; keep only full sequences."""
    ended = df.withColumn(ids, F.concat(F.col(ids), F.array(F.lit(eos_id).cast("bigint"))))
    return pack_blocks(
        ended, ids, seq_length, order_by, batch_rows, split,
        keep_short=False, bucket_rows=bucket_rows,
    )


def pack_budget(
    df: DataFrame,
    ids: str,
    chars: str,
    seq_length: int,
    eos_id: int,
    budget: int,
    order_by: Sequence[str],
    split: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Join documents with an end marker after each, buffer by buffer; keep only full sequences.

    A buffer takes documents in order until they hold ``budget`` characters (column
    ``chars``). Only a table of keys and sizes is ordered and summed; arrays are cut
    at its offsets. Returns (split, buffer, block, ids, labels).
    """
    keys = [*([split] if split else []), *order_by]
    ended = df.withColumn(ids, F.concat(F.coalesce(F.col(ids), F.array().cast("array<bigint>")), F.array(F.lit(eos_id).cast("bigint"))))
    sizes = df.select(*keys, F.col(chars).alias("_chars"), (F.coalesce(F.size(ids), F.lit(0)) + 1).cast("bigint").alias("_size"))
    placed = budget_segments(sizes, list(order_by), "_chars", budget, split, out="buffer", bucket_rows=bucket_rows)
    within = [*([split] if split else []), "buffer"]
    earlier = Window.partitionBy(*within).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    placed = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], "buffer", "_start", "_size")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    located = ended.select(*keys, ids).join(placed, same).drop(*[f"_{k}" for k in keys])
    packed = _cut(located, [ids], seq_length, within, keep_short=False)
    return packed.withColumn("labels", F.col(ids))


def assemble_batches(
    df: DataFrame,
    columns: Sequence[str],
    size: int,
    order_by: str | Sequence[str],
    shuffle_seed: int | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Lists of rows to rows of lists: (batch, n_rows, one array per column)."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    order: OrderBy = order_by
    if shuffle_seed is not None:
        order = [shuffle_key(shuffle_seed, *order_by), *order_by]
    placed = _placed(df, size, order, None, bucket_rows)
    rows = F.array_sort(
        F.collect_list(F.struct("_pos", *columns)), lambda a, b: (a["_pos"] - b["_pos"]).cast("int")
    )
    grouped = placed.groupBy("_bucket", "batch").agg(rows.alias("_rows"))
    return grouped.select(
        "batch",
        F.size("_rows").alias("n_rows"),
        *[F.col(f"_rows.{c}").alias(c) for c in columns],
    )


def pad_columns(df: DataFrame, fills: Mapping[str, int], length: int) -> DataFrame:
    """Pad array columns to a fixed length, each with its own value."""
    return df.withColumns({c: pad_array(F.col(c), length, fill) for c, fill in fills.items()})


def _longest(lists: Column) -> Column:
    return F.array_max(F.transform(lists, lambda x: F.size(x)))


def pad_batches(
    batches: DataFrame, fills: Mapping[str, int], mask_of: str | None = None
) -> DataFrame:
    """Pad assembled arrays of arrays to the longest of their batch.

    ``mask_of`` adds ``attention_mask`` for that column.
    """

    def padded(column: str, fill: int) -> Column:
        return bind(
            _longest(F.col(column)),
            lambda n: F.transform(column, lambda x: pad_array(x, n, fill)),
        )

    batches = batches.withColumns({c: padded(c, fill) for c, fill in fills.items()})
    if mask_of is not None:
        pad_id = fills[mask_of]
        masks = F.transform(mask_of, lambda x: attention_mask(x, pad_id))
        batches = batches.withColumn("attention_mask", masks)
    return batches


def collate_ragged(
    batches: DataFrame, on_ragged: str = "pad", fills: Mapping[str, int] | None = None
) -> DataFrame:
    """Make the lists of each batch equally long and add the flag ``ragged``.

    ``repeat_first`` repeats the first example of a ragged batch; ``pad`` pads
    with 0, labels with the ignored id, or the given values. ``label`` or
    ``label_ids`` become ``labels``: integers BIGINT, else DOUBLE. Text columns
    are left out.
    """
    if on_ragged not in ("pad", "repeat_first"):
        raise ValueError(f"unknown ragged rule: {on_ragged}")
    label = next((c for c in ("label", "label_ids") if c in batches.columns), None)
    values = [
        f.name
        for f in batches.schema.fields
        if isinstance(f.dataType, T.ArrayType)
        and f.name not in ("label", "label_ids")
        and not isinstance(f.dataType.elementType, T.StringType)
    ]
    lists = [c for c in values if isinstance(batches.schema[c].dataType.elementType, T.ArrayType)]
    ragged = F.lit(False)
    for c in lists:
        shortest = F.array_min(F.transform(F.col(c), lambda x: F.size(x)))
        ragged = ragged | (shortest != _longest(F.col(c)))
    result = batches.withColumn("ragged", ragged)
    if on_ragged == "repeat_first":
        changed = {
            c: F.when(
                F.col("ragged"), F.array_repeat(F.get(F.col(c), F.lit(0)), F.col("n_rows"))
            ).otherwise(F.col(c))
            for c in values
        }
        result = result.withColumns(changed)
    else:
        defaults = {c: IGNORE_INDEX if c == "labels" else 0 for c in lists}
        result = pad_batches(result, {**defaults, **(fills or {})})
    kept = [c for c in batches.columns if c in values or c in ("batch", "n_rows")]
    if label is None:
        return result.select(*kept, "ragged")
    item = batches.schema[label].dataType.elementType
    base = item.elementType if isinstance(item, T.ArrayType) else item
    kind = "bigint" if isinstance(base, T.IntegralType) else "double"
    nested = f"array<array<{kind}>>" if isinstance(item, T.ArrayType) else f"array<{kind}>"
    return result.select(*kept, F.col(label).cast(nested).alias("labels"), "ragged")
