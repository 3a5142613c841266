"""Places for a caller's own functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.constants import MAP_BATCH_ROWS

__all__ = ["map_batches", "token_udf", "apply_metrics"]


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    batch_rows: int = MAP_BATCH_ROWS,
    remove_columns: Sequence[str] = (),
) -> DataFrame:
    """Apply Python code to batches of at most ``batch_rows`` rows.

    Batches follow the partitions, which are the workers; ``fn`` may return
    another number of rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                yield fn(frame.iloc[start : start + batch_rows].reset_index(drop=True))

    return df.mapInPandas(run, schema).drop(*remove_columns)


def token_udf(fn: Callable[[str], Sequence[int]]) -> Callable[[Column], Column]:
    """Wrap a tokenizer (text to ids) for ``encode``; runs on Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(fn(t)))

    return run


def apply_metrics(
    df: DataFrame, metrics: Sequence[Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Union the (metric, value) rows of several metric functions."""
    result = None
    for metric in metrics:
        rows = metric(df).select(
            F.col("metric").cast("string"), F.col("value").cast("double")
        )
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        raise ValueError("no metric functions")
    return result
