"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Items and documents are words without the punctuation at their ends, A-Z lower-cased.
Every 3-gram of an item is a seed, however frequent it is, so that an item that leaked
into many documents keeps its seeds, edited or cut short as it may be. Wherever a
document holds a seed, the item is aligned with the words around it: a match earns 2, a
different word or a gap costs 1. An item is found when the score reaches ``threshold``
of what the whole item would earn. The words around reach as far as any such alignment can:
one with more gaps than MATCH * (1 - threshold) times the item's length cannot reach the threshold. Common phrases start few alignments: no alignment has
more matches than the item and the words around share, counted with their repeats, and
where that many would not reach the threshold there is nothing to find.

The seeds of at most BLOCK_WORDS words of items travel with a task; a larger benchmark
is searched in blocks. Documents are scanned once for each block, where they lie, and
never shuffled.

Rows: NULL or empty texts and items match nothing. An item shorter than a seed is one
seed of its own length. Repeated items and documents are each reported. NULL ids stay
NULL. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import BASE, BYTE_CODES, INVERSE, LOWER, flat_bytes, mix, pieces, powers, split_words, strip_punctuation

SEED = 3
THRESHOLD = 0.5
MATCH, MISS, GAP = 2, 1, 1
BLOCK_WORDS = 1_000_000
_WINDOW_WORDS = 1 << 20  # compared at a time


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word without punctuation at its ends, offsets); words of punctuation go."""
    words = split_words(data, offsets, lower=True)
    start, end = strip_punctuation(data, words.start, words.end)
    keep = end > start
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    start, end = start[keep], end[keep]
    out, table, at = np.empty(len(start), np.uint64), BYTE_CODES[LOWER], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + (1 << 20))))
        lo, hi = int(start[at]), int(end[to - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * powers(BASE, hi - lo), out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * powers(INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64))
        at = to
    return out, first


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the words i .. i + size - 1 for every i, across borders too."""
    n = max(len(codes) - size + 1, 0)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(BASE) + codes[i : i + n])
    return out


def _owned(item: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One hash for an item and a word."""
    return mix(codes * np.uint64(BASE) + item.astype(np.uint64))


@dataclass
class Items:
    """A block of items: their words, sorted by hash their seeds, and how often each word occurs in each item."""

    ids: list
    words: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sizes: np.ndarray
    word_keys: np.ndarray
    word_counts: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Items:
        codes, first = word_codes(*flat_bytes(pa.array([r[1] for r in rows], pa.string())))
        words = [codes[a:b] for a, b in zip(first[:-1], first[1:])]
        keys, item, place, sizes = [], [], [], []
        for i, w in enumerate(words):
            size = min(SEED, len(w))
            grams = _grams(w, size) if size else np.zeros(0, np.uint64)
            keys.append(grams)
            item.append(np.full(len(grams), i))
            place.append(np.arange(len(grams)))
            sizes.append(np.full(len(grams), size))
        key = np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        columns = [np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)[order] for c in (item, place, sizes)]
        owner = np.repeat(np.arange(len(words)), np.diff(first))
        return cls([r[0] for r in rows], words, key[order], *columns, *np.unique(_owned(owner, codes), return_counts=True))

    def hits(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word, seed number) of every seed found within a document."""
        found = []
        for size in np.unique(self.sizes):
            some = np.flatnonzero(self.sizes == size)
            keys = self.keys[some]
            grams = _grams(codes, int(size))
            lo = np.searchsorted(keys, grams, "left")
            at = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == grams)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, hi = lo[at], np.searchsorted(keys, grams[at], "right")
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            found.append((np.repeat(doc, hi - lo), np.repeat(at, hi - lo), some[which.astype(np.int64)]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))

    def shared(self, codes: np.ndarray, item: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
        """How many words each item has in common with codes[since:until]; no alignment has more matches."""
        out, at = np.zeros(len(item), np.int64), 0
        ends = np.cumsum(until - since)
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _WINDOW_WORDS, "right")))
            size = (until - since)[at:to]
            window = np.repeat(np.arange(at, to), size)
            word = np.arange(len(window)) + np.repeat(since[at:to] - (np.cumsum(size) - size), size)
            keys = _owned(item[window], codes[word])
            which = np.minimum(np.searchsorted(self.word_keys, keys), len(self.word_keys) - 1)
            known = self.word_keys[which] == keys
            pairs, n = np.unique(window[known] * len(self.word_keys) + which[known], return_counts=True)
            np.add.at(out, pairs // len(self.word_keys), np.minimum(n, self.word_counts[pairs % len(self.word_keys)]))
            at = to
        return out


def _align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score and the number of text words up to its end."""
    steps = np.arange(len(text) + 1) * GAP
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(text == word, MATCH, -MISS)
        fresh = np.maximum(row - GAP, 0)
        np.maximum(fresh[1:], diagonal, out=fresh[1:])
        row = np.maximum.accumulate(fresh + steps) - steps
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, from, to): the best local alignment and the text words it covers."""
    score, end = _align(item, text)
    if not score:
        return 0, 0, 0
    _, back = _align(item[::-1], text[:end][::-1])
    return score, end - back, end


def _matches(items: Items, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple]:
    """(document row, item row, score share, from word, to word): the best place of each item."""
    codes, first = word_codes(data, offsets)
    doc, at, seed = items.hits(codes, first)
    item = items.item[seed]
    shift = at - items.place[seed]
    order = np.lexsort((shift, item, doc))
    doc, item, shift = doc[order], item[order], shift[order]
    length = np.array([len(w) for w in items.words], np.int64)
    best: dict[tuple[int, int], tuple] = {}
    if not len(doc):
        return []
    slack = np.floor(MATCH * (1 - threshold) * length[item] / GAP + 1e-9).astype(np.int64)
    apart = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(shift) > slack[1:])
    cuts = np.flatnonzero(apart) + 1
    lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]])
    doc, item, since, until = doc[lo], item[lo], shift[lo] - slack[lo], shift[hi - 1] + (length[item] + slack)[lo]
    since, until = np.maximum(first[doc], since), np.minimum(first[doc + 1], until)
    able = MATCH * items.shared(codes, item, since, until) >= threshold * MATCH * length[item]
    for d, i, a, b in zip(*(x[able].tolist() for x in (doc, item, since, until))):
        full = MATCH * int(length[i])
        known = best.get((d, i))
        if known and known[2] >= 1.0:
            continue
        score, start, end = smith_waterman(items.words[i], codes[a:b])
        if score >= threshold * full and (known is None or score / full > known[2]):
            best[d, i] = (d, i, score / full, a + start - int(first[d]), a + end - int(first[d]))
    return list(best.values())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_WORDS words (or one item)."""
    rows, size = [], 0
    words = F.regexp_count(F.col(text_col), F.lit(r"\S+"))
    source = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), words.alias("n"))
    for r in source.where("t is not null").orderBy("i", "t").toLocalIterator():
        if rows and size + r["n"] > BLOCK_WORDS:
            yield Items.of(rows)
            rows, size = [], 0
        rows.append((r["i"], r["t"]))
        size += r["n"]
    if rows:
        yield Items.of(rows)


def contaminated_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, score, word_from, word_to) of every item found in a document, at its best place."""
    schema = f"{id_col} long, {item_id} long, score double, word_from long, word_to long"
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for items in list(_blocks(benchmark, item_id, text_col)):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 1):
                rows = _matches(items, *flat_bytes(batch.column(1)), threshold)
                ids = batch.column(0)
                columns = [
                    ids.take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                    *[pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))],
                ]
                yield pa.record_batch(columns, [id_col, item_id, "score", "word_from", "word_to"])

        found = found.unionByName(source.mapInArrow(run, schema))
    return found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents in which no item is found; all columns stay."""
    place = docs.columns.index(text_col)
    for items in list(_blocks(benchmark, item_id, text_col)):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, place):
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in _matches(items, *flat_bytes(batch.column(place)), threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
