"""Column functions on arrays; none of them needs a shuffle or a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "bind",
    "array_intersection",
    "argmax",
    "pad_array",
    "attention_mask",
    "mask_prefix",
    "chunk_array",
    "join_ids",
]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    A column used in a lambda would otherwise be computed again for every item
    when the optimizer merges the projections.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_intersection(left: Column, right: Column) -> Column:
    """Items of ``left`` found in ``right``: order of ``left``, duplicates kept, NULL items dropped.

    Both are sorted together, so long lists cost n log n: an item of ``right`` sorts just
    before the equal items of ``left``, and such a run is one slice.
    """
    marks = F.transform(F.array_distinct(right), lambda x: F.struct(x.alias("item"), F.lit(-1).alias("at")))
    items = F.transform(left, lambda x, i: F.struct(x.alias("item"), i.alias("at")))
    both = F.sort_array(F.filter(F.concat(marks, items), lambda r: r["item"].isNotNull()))

    def found(rows: Column) -> Column:
        changes = F.filter(
            F.transform(rows, lambda r, k: F.when((k > 0) & (r["item"] != F.get(rows, k - 1)["item"]), k)), lambda k: k.isNotNull()
        )
        ends = F.concat(changes, F.array(F.size(rows)))
        begins = F.concat(F.array(F.lit(0)), changes)
        runs = F.filter(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda r: F.get(rows, r["b"])["at"] == -1)
        return F.flatten(F.transform(runs, lambda r: F.slice(rows, r["b"] + 2, r["e"] - r["b"] - 1)))

    ordered = F.sort_array(F.transform(bind(both, found), lambda r: F.struct(r["at"], r["item"])))
    return F.transform(ordered, lambda r: r["item"])


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pad_array(values: Column, length: Column | int, fill: int) -> Column:
    """Append ``fill`` up to ``length``; a longer array stays as it is."""
    length = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(length - F.size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(F.lit(fill), missing))


def attention_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: (x != F.lit(pad_id)).cast("int"))


def mask_prefix(ids: Column, length: Column, ignore: int) -> Column:
    """``ids`` with the first ``length`` items replaced by ``ignore``."""
    return bind(
        F.least(length, F.size(ids)),
        lambda n: F.concat(
            F.array_repeat(F.lit(ignore).cast("bigint"), n), F.slice(ids, n + 1, F.size(ids))
        ),
    )


def chunk_array(values: Column, size: int) -> Column:
    """Cut an array into consecutive pieces of ``size``; the last may be shorter."""

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(size))
        pieces = F.transform(starts, lambda i: F.slice(v, i, F.lit(size)))
        return F.filter(pieces, lambda p: F.size(p) > 0)

    return bind(values, cut)


def join_ids(ids: Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), sep)
