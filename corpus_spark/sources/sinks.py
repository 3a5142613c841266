"""Writers. Every path is a Hadoop URI (``file://``, ``hdfs://``, ``s3a://``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.sources.versions import add_version, current_version, version_path

__all__ = [
    "write_splits",
    "write_csv",
    "publish",
    "copy_dataset",
    "write_metrics",
    "speed_metrics",
]


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    """Write a new version of the dataset beside the current one, then switch to it."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*by).parquet(version_path(path, version))
    add_version(spark, path, version)


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Save a dataset with one folder per split, for ``read_splits``.

    Readers see the old version until the new one is complete, and for good if the write
    fails; so ``df`` may read from ``path``. ``append`` adds to the current version.
    """
    if mode == "append" and current_version(df.sparkSession, path) is not None:
        df.write.partitionBy("split").mode(mode).parquet(current_version(df.sparkSession, path))
    else:
        _replace(df, path, ["split"])
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """Save one table as CSV with a header row, replacing an older one."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .mode("overwrite")
        .csv(path)
    )
    return path


def publish(df: DataFrame, root: str, name: str, revision: str | None = None) -> str:
    """Save splits under a name and revision, where ``read_named`` finds them."""
    path = "/".join([root.rstrip("/"), name, *([revision] if revision else [])])
    return write_splits(df, path)


def copy_dataset(spark: SparkSession, src: str, dst: str) -> str:
    """Copy a saved dataset to another location and keep its split folders."""
    df = spark.read.parquet(current_version(spark, src) or src)
    _replace(df, dst, ["split"] if "split" in df.columns else [])
    return dst


def write_metrics(df: DataFrame, path: str, run: str, split: str) -> str:
    """Append rows (run, split, metric, value) to a metric log."""
    rows = df.select(
        F.lit(run).alias("run"),
        F.lit(split).alias("split"),
        F.col("metric").cast("string"),
        F.col("value").cast("double"),
    )
    rows.write.mode("append").json(path)
    return path


def speed_metrics(spark: SparkSession, rows: int, seconds: float) -> DataFrame:
    """Runtime and samples per second of a finished job as metric rows."""
    return spark.createDataFrame(
        [
            ("runtime", float(seconds)),
            ("samples", float(rows)),
            ("samples_per_second", rows / seconds if seconds > 0 else float("inf")),
        ],
        "metric string, value double",
    )
