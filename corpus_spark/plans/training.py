"""Training-data plans: rows with ids, masks and labels, and their batches."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.constants import (
    BUFFER_SEQUENCES,
    EOS_ID,
    IGNORE_INDEX,
    INFERENCE_NO_INPUT,
    INFERENCE_WITH_INPUT,
    INSTRUCTION_TEMPLATE,
    MAP_BATCH_ROWS,
    PAD_ID,
    RATIO_EXAMPLES,
    SEQ2SEQ_OPTIONS,
    SEQ2SEQ_PROMPT,
    TRAIN_OPTIONS,
    TRAIN_PROMPT,
)
from corpus_spark.functions.arrays import attention_mask
from corpus_spark.functions.text import fill_template, instruction_with_input
from corpus_spark.operators.metrics import ratio_of
from corpus_spark.operators.order import head_n, take_per_group
from corpus_spark.operators.packing import (
    assemble_batches,
    pack_blocks,
    pack_budget,
    pad_batches,
    pad_columns,
    resolve_block_size,
)
from corpus_spark.operators.schema import drop_columns, encode_label
from corpus_spark.operators.tokens import encode, sft_encode
from corpus_spark.session import materialize

__all__ = [
    "train_prompt",
    "limit_splits",
    "source_target_pairs",
    "instruction_pairs",
    "request_prompt",
    "classifier_data",
    "classifier_batches",
    "sft_data",
    "sft_batches",
    "pretrain_data",
    "constant_length_data",
    "preference_data",
    "seq2seq_data",
]


def train_prompt(text: Column, template: str = TRAIN_PROMPT) -> Column:
    return fill_template(template, {"sentence1": text, "options_": TRAIN_OPTIONS})


def request_prompt(instruction: Column, text: Column | None = None) -> Column:
    """The request text for inference, with or without an input."""
    if text is None:
        return fill_template(INFERENCE_NO_INPUT, {"instruction": instruction})
    return fill_template(INFERENCE_WITH_INPUT, {"instruction": instruction, "input": text})


def limit_splits(
    df: DataFrame, max_samples: Mapping[str, int] | None, key: str | Sequence[str]
) -> DataFrame:
    """The first rows of each split in key order."""
    return take_per_group(df, "split", max_samples, key) if max_samples else df


def source_target_pairs(
    df: DataFrame, text: str, label: str, eos: str, template: str = TRAIN_PROMPT
) -> DataFrame:
    """Add ``sources`` (the filled prompt) and ``targets`` (label and end marker)."""
    return df.withColumns(
        {
            "sources": train_prompt(F.col(text), template),
            "targets": F.concat(F.col(label).cast("string"), F.lit(eos)),
        }
    )


def instruction_pairs(
    df: DataFrame, instruction: Column, text: str, output: str, eos: str
) -> DataFrame:
    """Add ``sources`` from instruction and optional input, and ``targets``."""
    asked = instruction_with_input(instruction, F.col(text))
    return df.withColumns(
        {
            "sources": fill_template(INSTRUCTION_TEMPLATE, {"instruction": asked}),
            "targets": F.concat(F.col(output).cast("string"), F.lit(eos)),
        }
    )


def classifier_data(
    df: DataFrame,
    text: str,
    label: str,
    key: str,
    vocab: DataFrame | None,
    max_len: int,
    max_samples: Mapping[str, int] | None = None,
    label_mapping: Mapping[str, int] | None = None,
    pad_to: int | None = None,
    **options: object,
) -> DataFrame:
    """Rows (key, split, input_ids, attention_mask, labels) for a text classifier."""
    rows = limit_splits(df, max_samples, key)
    if label_mapping is not None:
        rows = encode_label(rows, label_mapping, label, "labels")
    elif label != "labels":
        rows = rows.withColumnRenamed(label, "labels")
    rows = encode(rows.select(key, "split", text, "labels"), text, vocab, max_len=max_len, **options)
    if pad_to is not None:
        rows = pad_columns(rows, {"input_ids": PAD_ID}, pad_to)
    return rows.select(
        key, "split", "input_ids", attention_mask(F.col("input_ids"), PAD_ID).alias("attention_mask"), "labels"
    )


def classifier_batches(
    rows: DataFrame, key: str, size: int = 2, shuffle_seed: int | None = None
) -> DataFrame:
    """Batches padded to their longest row."""
    batches = assemble_batches(rows, ["input_ids", "attention_mask", "labels"], size, key, shuffle_seed)
    return pad_batches(batches, {"input_ids": PAD_ID, "attention_mask": 0})


def sft_data(
    df: DataFrame,
    text: str,
    label: str,
    key: str,
    vocab: DataFrame | None,
    max_len: int,
    eos: str = "</s>",
    max_samples: Mapping[str, int] | None = None,
    **options: object,
) -> DataFrame:
    """Rows (key, split, input_ids, labels) with the prompt hidden in the labels."""
    rows = source_target_pairs(limit_splits(df, max_samples, key), text, label, eos)
    rows = rows.select(key, "split", "sources", "targets")
    encoded = sft_encode(rows, "sources", "targets", vocab, max_len, specials=[eos], **options)
    return encoded.select(key, "split", "input_ids", "labels")


def sft_batches(
    rows: DataFrame, key: str, size: int = 2, shuffle_seed: int | None = None
) -> DataFrame:
    batches = assemble_batches(rows, ["input_ids", "labels"], size, key, shuffle_seed)
    return pad_batches(batches, {"input_ids": PAD_ID, "labels": IGNORE_INDEX}, mask_of="input_ids")


def pretrain_data(
    df: DataFrame,
    text: str,
    key: str,
    vocab: DataFrame | None,
    block_size: int | None,
    model_max: int = 1024,
    batch_rows: int = MAP_BATCH_ROWS,
    max_samples: Mapping[str, int] | None = None,
    drop: Sequence[str] = ("text_size", "text_length"),
    **options: object,
) -> DataFrame:
    """Blocks (split, batch, block, input_ids, labels), limited per split at the end."""
    rows = drop_columns(df, drop).select(key, "split", text)
    encoded = encode(rows, text, vocab, **options)
    block = resolve_block_size(block_size, model_max)
    blocks = pack_blocks(encoded, "input_ids", block, key, batch_rows, split="split")
    return limit_splits(blocks, max_samples, ["batch", "block"])


def constant_length_data(
    df: DataFrame,
    text: str,
    key: str,
    vocab: DataFrame | None,
    seq_length: int,
    max_train: int | None = None,
    eos_id: int = EOS_ID,
    sequences: int = BUFFER_SEQUENCES,
    examples: int = RATIO_EXAMPLES,
    bucket_rows: int | None = None,
    **options: object,
) -> tuple[DataFrame, DataFrame]:
    """Packed prompts of train and validation, and the characters-per-token ratio of train.

    A buffer closes at the characters that ``sequences`` sequences are expected to hold, by
    the ratio over the first ``examples`` prompts of train; only those are encoded for it.
    """
    rows = df.where(F.col("split").isin("train", "validation"))
    rows = limit_splits(rows, {"train": max_train} if max_train is not None else None, key)
    prompts = rows.select(key, "split", train_prompt(F.col(text)).alias("prompt"))
    train = prompts.where(F.col("split") == "train")
    first = encode(head_n(train, examples, key), "prompt", vocab, **options)
    ratio = materialize(ratio_of(first, "prompt", "input_ids"), "ratio")
    known = ratio.first()["ratio"] or 1.0
    budget = max(1, math.ceil(seq_length * known * sequences))
    encoded = encode(prompts, "prompt", vocab, **options)
    encoded = materialize(encoded.select(key, "split", "input_ids", F.length("prompt").alias("chars")), "encoded")
    packed = pack_budget(encoded, "input_ids", "chars", seq_length, eos_id, budget, [key], "split", bucket_rows)
    return packed, ratio


def preference_data(
    df: DataFrame, text: str, key: str, vocab: DataFrame | None, max_len: int, **options: object
) -> DataFrame:
    """Prompt ids cut and padded to ``max_len``; the original columns are dropped."""
    prompts = df.select(key, train_prompt(F.col(text)).alias("prompt"))
    encoded = encode(prompts, "prompt", vocab, max_len=max_len, **options)
    padded = pad_columns(encoded, {"input_ids": PAD_ID}, max_len)
    return padded.select(
        key, "input_ids", attention_mask(F.col("input_ids"), PAD_ID).alias("attention_mask")
    )


def seq2seq_data(
    df: DataFrame,
    text: str,
    target: str,
    key: Sequence[str],
    vocab: DataFrame | None,
    max_len: int,
    **options: object,
) -> DataFrame:
    """Prompt ids and target ids per row, both cut and padded to ``max_len``."""
    prompt = fill_template(
        SEQ2SEQ_PROMPT, {"sentence1": F.col(text), "options_": SEQ2SEQ_OPTIONS}
    )
    rows = df.select(*key, prompt.alias("prompt"), F.col(target).alias("target"))
    rows = encode(rows, "prompt", vocab, "input_ids", max_len=max_len, **options)
    rows = encode(rows, "target", vocab, "labels", max_len=max_len, **options)
    rows = pad_columns(rows, {"input_ids": PAD_ID, "labels": PAD_ID}, max_len)
    return rows.select(
        *key,
        "input_ids",
        attention_mask(F.col("input_ids"), PAD_ID).alias("attention_mask"),
        "labels",
    )
