"""Readers. Every path is a Hadoop URI (``file://``, ``hdfs://``, ``s3a://``)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.session import materialize
from corpus_spark.sources.versions import current_version

__all__ = [
    "read_csv",
    "read_named",
    "read_any",
    "read_text",
    "read_splits",
    "preview",
    "cached_or",
    "cached_files",
    "path_exists",
    "spread",
    "FILE_SUFFIXES",
]

FILE_SUFFIXES = (".csv", ".json", ".txt")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of fewer splits than cores one task per core.

    Meant before costly narrow work on few or unsplittable files; a table with
    enough splits, as any large one has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    multi_line: bool = False,
    infer_types: bool = False,
) -> DataFrame:
    """CSV with a header row, all columns STRING unless a schema is given.

    ``columns`` forces names by position and skips the header row.
    ``infer_types`` finds column types in one more pass. Quoted line breaks need ``multi_line``,
    which reads a file in one task: store such inputs as many files.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )
    if schema is None and columns is not None:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", True)
    elif infer_types:
        reader = reader.option("inferSchema", True)
    return reader.csv(path if isinstance(path, str) else list(path))


def read_named(
    spark: SparkSession,
    root: str,
    name: str,
    split: str | None = None,
    revision: str | None = None,
    subset: str | None = None,
) -> DataFrame:
    """A published dataset; ``split`` prunes partitions and drops the column."""
    path = "/".join([root.rstrip("/"), name, *[p for p in (subset, revision) if p]])
    df = spark.read.parquet(current_version(spark, path) or path)
    if split is None:
        return df
    return df.where(F.col("split") == split).drop("split")


def read_any(
    spark: SparkSession,
    source: str,
    root: str,
    split: str | None = None,
    revision: str | None = None,
    schema: T.StructType | None = None,
    infer_types: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read ``source`` below ``root``: a file by its suffix, else a published dataset."""
    path = f"{root.rstrip('/')}/{source}"
    if source.endswith(".csv"):
        return read_csv(spark, path, schema=schema, multi_line=multi_line, infer_types=infer_types)
    if source.endswith(".json"):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if source.endswith(".txt"):
        return read_text(spark, path, glob=None)
    return read_named(spark, root, source, split=split, revision=revision)


def read_text(
    spark: SparkSession,
    path: str,
    glob: str | None = "*.txt",
    keep_file: bool = False,
    keep_linebreaks: bool = False,
    only_first_file: bool = False,
) -> DataFrame:
    """Plain text, one row per line, optionally with the name of its file.

    ``only_first_file`` reads just the first file by name, for a quick trial.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path)
    text = F.concat("value", F.lit("\n")) if keep_linebreaks else F.col("value")
    lines = lines.select(text.alias("text"), F.col("_metadata.file_name").alias("file"))
    if only_first_file:
        lines = lines.where(F.col("file") == lines.agg(F.min("file")).scalar())
    return lines if keep_file else lines.drop("file")


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset saved with ``write_splits``; ``split`` prunes partitions."""
    df = spark.read.parquet(current_version(spark, path) or path)
    return df if split is None else df.where(F.col("split") == split)


def cached_or(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The finished table at ``path``; built and written there if it is missing."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_files(
    spark: SparkSession, path: str, cache: str, build: Callable[[DataFrame], DataFrame], glob: str = "*.txt"
) -> DataFrame:
    """One cached result for each text file below ``path``; only new and changed files are read again.

    ``build`` gets the lines (text, file) of those files and returns rows that keep the column
    ``file``. Its result is written as a batch, then the batch's files are entered in a
    manifest (file, size, modified, batch). A file counts as cached while size and time of
    change are those of its last entry; results of files that are gone are not returned. A
    run that fails leaves a batch without entries, which nobody reads.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    found = found.select(
        F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "path"
    )
    found = materialize(found, "files")
    state, manifest = ["file", "size", "modified"], f"{cache.rstrip('/')}/manifest"
    schema = found.select(*state, F.lit("").alias("batch")).schema

    def entries() -> DataFrame:
        known = spark.read.schema(schema).parquet(manifest) if path_exists(spark, manifest) else spark.createDataFrame([], schema)
        return found.join(known, state)

    changed = materialize(found.join(entries().select(*state), state, "left_anti"), "changed-files")
    names = [r[0] for r in changed.select("path").collect()]  # as many as Spark lists to read them
    if names:
        batch = uuid.uuid4().hex
        lines = spark.read.text(names).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
        build(lines).write.parquet(f"{cache.rstrip('/')}/batches/batch={batch}")
        changed.select(*state, F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(manifest)
    valid = materialize(entries().select("file", "batch").distinct(), "cached-files")
    batches = [f"{cache.rstrip('/')}/batches/batch={r[0]}" for r in valid.select("batch").distinct().collect()]
    if not batches:
        lines = spark.createDataFrame([], "text string, file string")
        return build(lines).withColumn("batch", F.lit(""))
    rows = spark.read.option("basePath", f"{cache.rstrip('/')}/batches").parquet(*batches)
    return rows.withColumn("batch", F.col("batch").cast("string")).join(valid, ["file", "batch"], "left_semi")


def preview(
    df: DataFrame, n: int, order_by: str | Column | Sequence[str | Column]
) -> tuple[int, list[str], DataFrame]:
    """Row count, column names and the first ``n`` rows in order."""
    from corpus_spark.operators.order import head_n

    return df.count(), df.columns, head_n(df, n, order_by)
