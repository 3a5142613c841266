"""Column roles, labels, projections and unions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.constants import (
    CASE_JOINER,
    INPUT_MAX_LENGTH,
    PROMPT_INSTRUCTION,
    PROMPT_OUTPUTS,
    SEPARATORS,
    TRAINER_COLUMNS,
)
from corpus_spark.functions.text import fits, repack

__all__ = [
    "intersection",
    "resolve_role",
    "canonical_columns",
    "add_constant",
    "drop_columns",
    "keep_columns",
    "encode_label",
    "decode_label",
    "unknown_labels",
    "prompt_rows",
    "repack_filter",
    "union_sources",
    "cross_cases",
]


def intersection(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Items of ``left`` found in ``right``: order of ``left``, duplicates kept."""
    known = set(right)
    return [item for item in left if item in known]


def resolve_role(
    columns: Sequence[str], candidates: Sequence[str], default: str | None
) -> str | None:
    """The last candidate that is a column, else the default."""
    found = intersection(candidates, columns)
    return found[-1] if found else default


def canonical_columns(
    df: DataFrame,
    index: int,
    text_candidates: Sequence[str] = ("text",),
    label_candidates: Sequence[str] = ("labels",),
    text_name: str = "text",
    label_name: str = "labels",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Select and rename the text and label columns of one source.

    A source without a label column gets its own position in the source list.
    """
    text = resolve_role(df.columns, text_candidates, "text")
    label = resolve_role(df.columns, label_candidates, None)
    label_column = F.lit(index).cast("int") if label is None else F.col(f"`{label}`")
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{text}`").cast("string").alias(text_name),
        label_column.alias(label_name),
    )


def add_constant(df: DataFrame, name: str, value: object, drop: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(name, F.lit(value)).drop(*drop)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def keep_columns(df: DataFrame, allowed: Sequence[str] = TRAINER_COLUMNS) -> DataFrame:
    """Drop every column that is not allowed."""
    return df.drop(*[c for c in df.columns if c not in set(allowed)])


def _lookup(column: Column, mapping: Mapping) -> Column:
    result = None
    for key, value in mapping.items():
        result = (F if result is None else result).when(column == F.lit(key), F.lit(value))
    return result


def encode_label(
    df: DataFrame, mapping: Mapping[str, int], source: str = "target", out: str = "labels"
) -> DataFrame:
    """Replace a text label by its code; an unknown text gives NULL."""
    coded = df.withColumn(out, _lookup(F.col(source), mapping).cast("int"))
    return coded if source == out else coded.drop(source)


def decode_label(
    df: DataFrame, mapping: Mapping[int, str], source: str = "labels", out: str = "target"
) -> DataFrame:
    """Add the class name of an integer label; an unknown code gives NULL."""
    return df.withColumn(out, _lookup(F.col(source), mapping))


def unknown_labels(df: DataFrame, mapping: Mapping, source: str) -> DataFrame:
    """Labels outside the mapping with their counts."""
    known = F.col(source).isin(list(mapping))
    return df.where(~F.coalesce(known, F.lit(False))).groupBy(source).agg(F.count("*").alias("n"))


def prompt_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``instruction`` and ``output`` to ``input`` rows and drop the label.

    Only integer labels are matched: text such as "0" has no output.
    """
    integral = isinstance(
        df.schema[label].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    )
    output = _lookup(F.col(label), PROMPT_OUTPUTS) if integral else F.lit(None).cast("string")
    return df.withColumns({"instruction": F.lit(PROMPT_INSTRUCTION), "output": output}).drop(label)


def repack_filter(
    df: DataFrame,
    column: str,
    max_length: int = INPUT_MAX_LENGTH,
    separators: Sequence[str] = SEPARATORS,
    source: str | None = None,
) -> DataFrame:
    """Repack a text column and drop the rows that do not fit.

    The explode over a filtered one-item array keeps a single copy of the
    repacking expression in the plan; a plain filter would evaluate it again
    for the predicate. The operation is narrow.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    fitting = F.filter(
        F.array(repack(F.col(column), max_length, separators, source)),
        lambda t: t.isNotNull() & fits(t, max_length),
    )
    return df.select(*others, F.explode(fitting).alias(column)).select(*df.columns)


def union_sources(frames: Sequence[DataFrame], label: str | None = None) -> DataFrame:
    """Concatenate sources row-wise, duplicates kept.

    Integer labels of different widths become BIGINT; any other difference
    between the schemas is an error that names the source.
    """
    if not frames:
        raise ValueError("no sources to concatenate")
    frames = list(frames)
    if label is not None:
        integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        types = {type(f.schema[label].dataType) for f in frames}
        if len(types) > 1 and all(issubclass(t, integral) for t in types):
            frames = [f.withColumn(label, F.col(label).cast("bigint")) for f in frames]
    expected = {f.name: f.dataType for f in frames[0].schema.fields}
    result = frames[0]
    for number, frame in enumerate(frames[1:], start=1):
        actual = {f.name: f.dataType for f in frame.schema.fields}
        if actual != expected:
            raise ValueError(f"source {number} has columns {actual}, expected {expected}")
        result = result.unionByName(frame)
    return result


def cross_cases(
    df: DataFrame,
    item: str | Column,
    values: Sequence[str],
    out: str = "case",
    joiner: str = CASE_JOINER,
) -> DataFrame:
    """Every item of a table joined with every value of a fixed list.

    The value list is part of the plan, so the product is a narrow explode.
    """
    item = F.col(item) if isinstance(item, str) else item
    choices = F.array(*[F.lit(v) for v in values])
    return df.withColumn("_value", F.explode(choices)).withColumn(
        out, F.concat(item, F.lit(joiner), F.col("_value"))
    ).drop("_value")
