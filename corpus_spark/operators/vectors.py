"""Vector averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.functions.arrays import bind

__all__ = ["mean_pool", "mean_vector", "impute_mean_vectors"]


def _assembled(parts: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """Rows (key, pos, value) to one array per key, one item per dimension."""
    items = F.array_sort(F.collect_list(F.struct("pos", value)))
    return parts.groupBy(*key).agg(F.transform(items, lambda p: p[value]).alias(out))


def mean_pool(
    df: DataFrame,
    key: str | Sequence[str],
    vector: str,
    mask: str,
    out: str = "vector",
    normalize: bool = True,
) -> DataFrame:
    """Mask-weighted mean of token vectors per key, scaled to length 1.

    Sums are combined before they move, so a key may hold any number of rows.
    """
    key = [key] if isinstance(key, str) else list(key)
    weight = F.col(mask).cast("double")
    parts = df.select(*key, weight.alias("w"), F.posexplode(vector).alias("pos", "v"))
    sums = parts.groupBy(*key, "pos").agg(
        (
            F.sum(F.col("v").cast("double") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))
        ).alias("mean")
    )
    pooled = _assembled(sums, key, "mean", out)
    if not normalize:
        return pooled
    squares = F.aggregate(out, F.lit(0.0), lambda a, x: a + x * x)
    norm = F.greatest(F.sqrt(squares), F.lit(1e-12))
    return pooled.withColumn(out, bind(norm, lambda n: F.transform(out, lambda x: x / n)))


def mean_vector(df: DataFrame, vector: str, out: str = "vector") -> DataFrame:
    """One row with the mean of all vectors."""
    parts = df.select(F.posexplode(vector).alias("pos", "v"))
    means = parts.groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
    return _assembled(means, [], "mean", out)


def impute_mean_vectors(df: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """Append rows for new keys; their vector is the mean of the existing ones."""
    item = df.schema[vector].dataType.simpleString()
    mean = mean_vector(df, vector).scalar()
    added = new.select(key).withColumn(vector, mean.cast(item))
    return df.select(key, vector).unionByName(added)
