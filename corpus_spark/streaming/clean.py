"""The stateless cleaning steps on a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.constants import INPUT_MAX_LENGTH, SEPARATORS, SHUFFLE_SEED
from corpus_spark.operators.order import shuffle_key
from corpus_spark.operators.schema import canonical_columns, prompt_rows, repack_filter

__all__ = ["clean_step", "hash_split", "clean_stream"]


def hash_split(seed: int, *key: str) -> Column:
    """Split of a row by its hash: 80/10/10 on average.

    The hash is the one that shuffles. A stream has no total, so sizes are approximate; ``split_exact`` needs a batch.
    """
    place = F.conv(F.substring(shuffle_key(seed, *key), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(place < 8, "train").when(place == 8, "validation").otherwise("test")


def clean_step(
    df: DataFrame,
    key: str,
    index: int = 0,
    text_candidates: Sequence[str] = ("text",),
    label_candidates: Sequence[str] = ("labels",),
    max_length: int = INPUT_MAX_LENGTH,
    separators: Sequence[str] = SEPARATORS,
    source: str | None = None,
) -> DataFrame:
    """Roles, repacking, length filter and prompt columns of one source."""
    rows = canonical_columns(
        df, index, text_candidates, label_candidates, "input", "label", keep=[key]
    )
    return prompt_rows(repack_filter(rows, "input", max_length, separators, source))


def clean_stream(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    checkpoint: str,
    schema: T.StructType,
    step: Callable[[DataFrame], DataFrame],
    key: str,
    split_seed: int | None = SHUFFLE_SEED,
    max_files: int = 1000,
    glob: str | None = None,
) -> None:
    """Clean all files that have arrived and append them to a Parquet table.

    A later run with the same checkpoint takes up only new files.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = step(reader.parquet(in_path))
    writer = rows.writeStream if split_seed is None else rows.withColumn(
        "split", hash_split(split_seed, key)
    ).writeStream.partitionBy("split")
    query = (
        writer.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
