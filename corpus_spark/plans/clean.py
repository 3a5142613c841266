"""Cleaning plans: several sources to one table with exact splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.constants import (
    INPUT_MAX_LENGTH,
    SEPARATORS,
    SHUFFLE_SEED,
    TARGET_TO_LABEL,
    TRIM_SEED,
)
from corpus_spark.operators.order import (
    balance_two,
    head_n,
    shuffle_key,
    split_counts,
    split_labels,
    take_per_group,
)
from corpus_spark.operators.schema import (
    add_constant,
    canonical_columns,
    prompt_rows,
    repack_filter,
    union_sources,
)
from corpus_spark.session import materialize, scratch_scope
from corpus_spark.sources.readers import read_any, read_named
from corpus_spark.sources.sinks import publish

__all__ = [
    "CleanConfig",
    "with_row_key",
    "clean_two_sources",
    "merge_and_split",
    "prompt_merge_and_split",
    "run_task",
    "TASKS",
]


KEY_RUN = 100_000


def with_row_key(df: DataFrame, key: str) -> DataFrame:
    """The table itself if it has the key, else a written copy with one made from the values.

    The key is a hash of all columns and the number of the occurrence, so it depends
    neither on the order nor on the partitions of the source. Equal rows are counted
    before they move and multiplied again.
    """
    if key in df.columns:
        return df
    # Each value after its length, so that no two rows read the same.
    texts = [F.col(c).cast("string") for c in df.columns]
    values = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit("="), t), F.lit("-")) for t in texts]
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    runs = F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {KEY_RUN} as int)"))
    counted = counted.withColumn("_run", F.explode(runs))
    last = F.least(F.lit(KEY_RUN - 1), F.col("_n") - 1 - F.col("_run") * KEY_RUN)
    counted = counted.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    number = (F.col("_run") * KEY_RUN + F.col("_i")).cast("string")
    made = F.concat_ws(":", F.md5(F.concat_ws("\x1f", *values)), number)
    return materialize(counted.withColumn(key, made).select(*df.columns, key), "numbered")


def _keyed(sources: Sequence[DataFrame], key: str) -> list[DataFrame]:
    """Sources with a key each; the keys become text where their types differ."""
    frames = [with_row_key(df, key) for df in sources]
    if len({df.schema[key].dataType for df in frames}) > 1:
        frames = [df.withColumn(key, F.col(key).cast("string")) for df in frames]
    return frames


def _split_and_trim(
    merged: DataFrame, key: str, train_length: int | None, trim_seed: int
) -> DataFrame:
    """Shuffle, split 80/10/10 and trim, all by predicates on the row key."""
    row_key = ["source", key]
    keys = materialize(merged.select(*row_key), "keys")
    order = [shuffle_key(SHUFFLE_SEED, *row_key), *row_key]
    label = split_labels(merged, order, split_counts, keys=keys)
    result = merged.withColumn("split", label)
    if train_length is None:
        return result
    quotas = {
        "train": train_length,
        "validation": train_length // 2,
        "test": train_length // 2,
    }
    trim_order = [shuffle_key(trim_seed, *row_key), *row_key]
    return take_per_group(
        result, "split", quotas, trim_order, keys=keys.withColumn("split", label)
    )


def clean_two_sources(
    ai: DataFrame,
    human: DataFrame,
    key: str = "id",
    number: int | None = None,
    zoom: int = 1,
) -> DataFrame:
    """Two text sources to balanced, split rows (source, key, text, target, split)."""
    targets = {code: text for text, code in TARGET_TO_LABEL.items()}
    ai, human = _keyed([ai, human], key)
    if number is not None:
        ai = head_n(ai, number, key)
    ai, human = balance_two(ai, human, key, zoom)
    frames = [
        add_constant(df.select(F.lit(i).alias("source"), key, "text"), "target", targets[i])
        for i, df in enumerate((ai, human))
    ]
    return _split_and_trim(union_sources(frames), key, None, SHUFFLE_SEED)


def _canonical(
    sources: Sequence[DataFrame],
    key: str,
    text_candidates: Sequence[str],
    label_candidates: Sequence[str],
    text_name: str,
    label_name: str,
) -> list[DataFrame]:
    return [
        canonical_columns(
            df, i, text_candidates, label_candidates, text_name, label_name, [key]
        ).select(F.lit(i).alias("source"), key, text_name, label_name)
        for i, df in enumerate(_keyed(sources, key))
    ]


def merge_and_split(
    sources: Sequence[DataFrame],
    key: str = "id",
    text_candidates: Sequence[str] = ("text",),
    label_candidates: Sequence[str] = ("labels",),
    train_length: int | None = None,
) -> DataFrame:
    """Sources to (source, key, text, labels, split); trimming reshuffles first."""
    frames = _canonical(sources, key, text_candidates, label_candidates, "text", "labels")
    return _split_and_trim(union_sources(frames, "labels"), key, train_length, TRIM_SEED)


def prompt_merge_and_split(
    sources: Sequence[DataFrame],
    key: str = "id",
    text_candidates: Sequence[str] = ("text",),
    label_candidates: Sequence[str] = ("labels",),
    train_length: int | None = None,
    max_length: int = INPUT_MAX_LENGTH,
    separators: Sequence[str] = SEPARATORS,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Sources to prompt rows (source, key, input, instruction, output, split).

    Texts are repacked to ``max_length`` and dropped where nothing fits; a name
    may select the separator of its source. Trimming keeps the shuffled order.
    """
    names = list(names) if names is not None else [""] * len(sources)
    frames = [
        repack_filter(df, "input", max_length, separators, name)
        for df, name in zip(
            _canonical(sources, key, text_candidates, label_candidates, "input", "label"), names
        )
    ]
    # Written once: the keys and the rows would each repack every text.
    rows = materialize(prompt_rows(union_sources(frames, "label")), "repacked")
    return _split_and_trim(rows, key, train_length, SHUFFLE_SEED)


@dataclass
class CleanConfig:
    """Options of a cleaning task.

    ``schema`` describes the CSV sources; without it their types are inferred,
    so that integer labels arrive as integers.
    """

    root: str
    sources: Sequence[str]
    task: str = "MERGE_SPLIT_SAVE"
    key: str = "id"
    text_candidates: Sequence[str] = ("text",)
    label_candidates: Sequence[str] = ("labels",)
    train_length: int | None = None
    max_length: int = INPUT_MAX_LENGTH
    separators: Sequence[str] = field(default_factory=lambda: SEPARATORS)
    schema: T.StructType | None = None
    save: bool = False
    target: str | None = None
    revision: str | None = None


def _sources(
    spark: SparkSession, cfg: CleanConfig, split: str, revision: str | None = None
) -> list[DataFrame]:
    return [
        read_any(
            spark, s, cfg.root, split, revision, schema=cfg.schema, infer_types=cfg.schema is None
        )
        for s in cfg.sources
    ]


def _run_merge(spark: SparkSession, cfg: CleanConfig) -> DataFrame:
    frames = _sources(spark, cfg, split="train", revision="validation")
    return merge_and_split(
        frames, cfg.key, cfg.text_candidates, cfg.label_candidates, cfg.train_length
    )


def _run_prompt(spark: SparkSession, cfg: CleanConfig) -> DataFrame:
    frames = _sources(spark, cfg, split="test")
    return prompt_merge_and_split(
        frames,
        cfg.key,
        cfg.text_candidates,
        cfg.label_candidates,
        cfg.train_length,
        cfg.max_length,
        cfg.separators,
        names=cfg.sources,
    )


TASKS = {"MERGE_SPLIT_SAVE": _run_merge, "PROMPT_MERGE_SPLIT_SAVE": _run_prompt}


def run_task(spark: SparkSession, cfg: CleanConfig) -> DataFrame:
    """Run a cleaning task by name; publish its result where asked to, then drop what it wrote on the way."""
    if cfg.task not in TASKS:
        raise ValueError(f"unknown task {cfg.task!r}, known: {sorted(TASKS)}")
    if cfg.save:
        with scratch_scope(spark):
            return _run_and_save(spark, cfg)
    return TASKS[cfg.task](spark, cfg)


def _run_and_save(spark: SparkSession, cfg: CleanConfig) -> DataFrame:
    result = TASKS[cfg.task](spark, cfg)
    if not cfg.target:
        raise ValueError("a saved task needs a target name")
    publish(result, cfg.root, cfg.target, cfg.revision)
    return read_named(spark, cfg.root, cfg.target, revision=cfg.revision)
