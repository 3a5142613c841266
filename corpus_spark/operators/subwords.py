"""Subwords of a pretrained byte-level vocabulary.

The vocabulary is a rank file: a token in base64 and its id on each line; pairs of bytes
are joined by falling frequency, which the ids are. The file is read through Spark, so it may
lie wherever tables do; its size is checked, as all of it travels to every task.
Encoding runs on Arrow batches; decoding stays in the JVM.
"""

from __future__ import annotations

from array import array
from base64 import b64decode
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.operators.tokens import lookup_list

__all__ = ["subword_vocab", "subword_tokenizer", "subword_decode"]

MAX_FILE_BYTES = 32 << 20
# Fixed value: how texts are cut before bytes are joined, as the published vocabularies were made.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[tuple[int, str], Callable[[str], list[int]]] = {}


def _rank_file(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0]
    if size > MAX_FILE_BYTES:
        raise ValueError(f"{path} holds {size} bytes, more than {MAX_FILE_BYTES}")
    return bytes(files.select("content").first()[0]).decode("ascii")


def _encoder(ranks: str, pieces: str) -> Callable[[str], list[int]]:
    """One tokenizer for each worker."""
    import tiktoken

    key = hash(ranks), pieces
    if key not in _loaded:
        known = {b64decode(token): int(rank) for token, rank in map(str.split, ranks.splitlines())}
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=pieces, mergeable_ranks=known, special_tokens={}).encode_ordinary
    return _loaded[key]


def subword_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a rank file; tokens are bytes, as a character may be spread over several."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", " ")
    return lines.select(F.unbase64(parts[0]).alias("token"), parts[1].cast("bigint").alias("id"))


def subword_tokenizer(spark: SparkSession, path: str, pieces: str = PIECES) -> Callable[[Column], Column]:
    """Text to ids, as ``tokenizer`` of ``encode`` and all that is built on it; NULL stays NULL.

    No text means a special token: what looks like one is cut like any other.
    """
    ranks = _rank_file(spark, path)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(texts: pa.Array) -> pa.Array:
        encode = _encoder(ranks, pieces)
        # One text at a time becomes Python objects; the ids of a batch are kept as 8 bytes each.
        ids, ends = array("q"), array("i", [0])
        for text in texts:
            if text.is_valid:
                ids.extend(encode(text.as_py()))
            ends.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, np.int64)), mask=texts.is_null())

    return run


def subword_decode(df: DataFrame, ids: str, vocab: DataFrame, out: str = "decoded", skip_ids: Sequence[int] = ()) -> DataFrame:
    """Add the text of an id column. Unknown ids are left out, bytes that are no character become U+FFFD."""
    source = F.transform(F.col(ids), lambda x: x.cast("bigint"))
    if skip_ids:
        source = F.filter(source, lambda x: ~x.isin(list(skip_ids)))
    df = lookup_list(df, source, vocab, "id", "token", "_bytes", F.lit(b""))
    text = F.unhex(F.array_join(F.transform("_bytes", F.hex), ""))
    return df.withColumn(out, F.make_valid_utf8(text.cast("string"))).drop("_bytes")
