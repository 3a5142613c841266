"""Substring dedup from winnowed anchors: cut every run of 20 words that also starts earlier.

Winnowed anchors of 8 words are the seeds. They are not extended to maximal repeats: what
a run of ``length`` words around an anchor can reach, 12 words to either side, is matched
by hash or in two sorted orders (see ``repeats`` for the steps). A longer repeat is the
union of its runs, so the same words go.

``substring_report`` gives figures and digests, ``substring_dedup`` the texts that stay,
``substring_spans`` the passages that go.

Rows: NULL text has no words. A text with fewer words than ``length`` has no window.
Rows that repeat a document (id and text) get the same result. Different texts under one id
are documents of their own, ordered by a hash of id and text; so are texts without an id,
which sort first. Other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import id_array
from corpus_spark.llm.repeats import Unit, repeated_spans

LENGTH = 20
ANCHOR = 8

_REPORT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)


def _unit(length: int) -> Unit:
    return Unit(words=True, length=length, trigger=max(1, round(length * ANCHOR / LENGTH)))


def _kept_words(data, starts, words, runs) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of a batch, each followed by a space, as one buffer; where each document's begin."""
    kept = np.ones(len(words.start) + 1, np.int8)
    for d, lo, hi in zip(*runs):
        kept[starts[d] + lo : starts[d] + hi] = 0
    kept = kept[:-1].astype(bool)
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, words.start[kept], 1)
    np.add.at(mask, words.end[kept], -1)
    inside = np.cumsum(mask[:-1]) > 0
    size = words.end - words.start
    target = np.cumsum(np.where(kept, size + 1, 0))
    total = int(target[-1]) if len(target) else 0
    buffer = np.full(total, 0x20, np.uint8)
    place = np.ones(total, bool)
    place[target[kept] - 1] = False
    buffer[place] = data[inside]
    return buffer, np.concatenate([[0], target])[starts]


def _report(docs, ids, data, offsets, starts, words, runs) -> pa.Table:
    removed = np.zeros(len(ids), np.int64)
    np.add.at(removed, runs[0], runs[2] - runs[1])
    buffer, bounds = _kept_words(data, starts, words, runs)
    digests = [
        hashlib.sha256(buffer[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]
    return pa.table(
        {
            "doc_id": id_array(ids),
            "n_words": pa.array(np.diff(starts), pa.int64()),
            "n_removed": pa.array(removed),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: n_words, n_removed and the SHA-256 of the words that stay, joined by spaces."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    unit = _unit(length)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return repeated_spans(source, unit, _report, schema, _REPORT)


def _cut_texts(docs, ids, data, offsets, starts, words, runs) -> pa.Table:
    buffer, bounds = _kept_words(data, starts, words, runs)
    texts = docs["text"].to_pylist()
    for d in np.unique(runs[0]).tolist():
        texts[d] = bytes(buffer[bounds[d] : max(bounds[d], bounds[d + 1] - 1)]).decode("utf-8", "replace")
    names = [n for n in docs.column_names if n not in ("bucket", "tag")]
    return docs.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents without the repeated runs; all rows and columns stay.

    A text that loses words becomes its other words, joined by one space; any other stays as it is.
    """
    carried = {f"c{i}": c for i, c in enumerate(docs.columns) if c != text_col}
    source = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(k) for k, c in carried.items()]
    )
    cut = repeated_spans(source, _unit(length), _cut_texts, source.schema, None)
    names = {c: k for k, c in carried.items()}
    return cut.select(*[F.col(names.get(c, "text")).alias(c) for c in docs.columns])


_PASSAGES = pa.schema(
    [("doc_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("passage", pa.string())]
)


def _passages(docs, ids, data, offsets, starts, words, runs) -> pa.Table:
    row, lo, hi = runs
    begin, end = words.start[starts[row] + lo], words.end[starts[row] + hi - 1]
    texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())]
    columns = [id_array(ids[row]), pa.array(lo, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array(texts, pa.string())]
    return pa.table(columns, _PASSAGES)


def substring_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each maximal run of words that goes: doc_id, first_word (from 0), n_words, passage as it stands."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, first_word long, n_words long, passage string"
    return repeated_spans(source, _unit(length), _passages, schema, _PASSAGES)
