"""Suffix-array dedup: cut every byte string of 100 that also starts earlier.

The text is parsed without prefixes: rolling-hash triggers of 32 bytes cut it into
phrases. Copies collapse in the dictionary. What is left is put into corpus order by
two sorted tables, one of the phrase ends at each trigger (dictionary) and one of what
follows it (parse); strings equal to depth 100 are neighbours in both.

Two changes to the textbook form: a trigger is the least hash of its neighbourhood,
not a hash divisible by a number, so that no phrase outgrows a string; and the order
is kept only to the depth of a string, so that it never needs a whole document.

Rows: NULL text counts as empty. A text shorter than ``length`` has no string. Rows
that repeat a document (id and text) get the same result; a string is not earlier than
itself. Different texts under one id are documents of their own, ordered by a hash of id and
text; so are texts without an id, which sort first. Other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.llm.buffers import flat_bytes, id_array
from corpus_spark.llm.repeats import Unit, repeated_spans

LENGTH = 100
TRIGGER = 32


def _grouped(runs: tuple[np.ndarray, ...], rows: int) -> np.ndarray:
    return np.searchsorted(runs[0], np.arange(rows + 1))


def kept_parts(data: np.ndarray, lo: int, hi: int, cuts: list[tuple[int, int]]) -> list[memoryview]:
    """What the cuts leave of data[lo:hi]."""
    parts, at = [], lo
    for a, b in cuts:
        parts.append(data[at : lo + a])
        at = lo + b
    parts.append(data[at:hi])
    return parts


def _report(docs, ids, data, offsets, starts, words, runs) -> pa.Table:
    owner = _grouped(runs, len(ids))
    sizes = np.diff(offsets)
    removed = np.zeros(len(ids), np.int64)
    np.add.at(removed, runs[0], runs[2] - runs[1])
    digests = []
    for d in range(len(ids)):
        cuts = [(int(runs[1][r]), int(runs[2][r])) for r in range(owner[d], owner[d + 1])]
        digest = hashlib.sha256()
        for part in kept_parts(data, int(offsets[d]), int(offsets[d + 1]), cuts):
            digest.update(part)
        digests.append(digest.hexdigest())
    return pa.table(
        {
            "doc_id": id_array(ids),
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(removed),
            "n_spans": pa.array(np.diff(owner), pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


_REPORT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
)


def suffix_array_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    unit = Unit(words=False, length=length, trigger=max(1, round(length * TRIGGER / LENGTH)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeated_spans(source, unit, _report, schema, _REPORT)


def _cut_texts(docs, ids, data, offsets, starts, words, runs) -> pa.Table:
    owner, texts = _grouped(runs, len(ids)), []
    present = docs["text"].is_valid().to_pylist()
    for d in range(len(ids)):
        if not present[d]:
            texts.append(None)
            continue
        cuts = [(int(runs[1][r]), int(runs[2][r])) for r in range(owner[d], owner[d + 1])]
        parts = kept_parts(data, int(offsets[d]), int(offsets[d + 1]), cuts)
        texts.append("".join(bytes(p).decode("utf-8", "ignore") for p in parts))
    names = [n for n in docs.column_names if n not in ("bucket", "tag")]
    out = docs.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))
    return out


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut out of the text; all rows and columns stay.

    A character that a cut splits goes with it.
    """
    carried = {f"c{i}": c for i, c in enumerate(docs.columns) if c != text_col}
    source = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in carried.items()]
    )
    unit = Unit(words=False, length=length, trigger=max(1, round(length * TRIGGER / LENGTH)))
    arrow = None
    cut = repeated_spans(source, unit, _cut_texts, source.schema, arrow)
    names = {c: k for k, c in carried.items()}
    return cut.select(*[F.col(names.get(c, "text")).alias(c) for c in docs.columns])
