"""Every occurrence of a string of ``length`` symbols that also starts earlier, over all documents.

A symbol is a byte or a word. The steps, each a Spark shuffle of small rows:

1. *Parse.* A window of ``trigger`` symbols whose hash is the least of all windows in
   some string of ``length`` symbols is a trigger. Every string holds at least one,
   and equal strings hold the same ones at the same places.
2. *Dictionary.* A trigger with all that a string around it can reach (its context)
   is looked up by hash. Where an equal context occurs earlier, every string through
   the trigger is a repeat at once: copies cost a row each, never a pair.
3. *Order.* Contexts that are distinct but share a trigger are sorted twice: by the
   text that ends with the trigger and by the text that follows it. Two strings
   through the trigger are equal when they are neighbours to the needed depth in both
   orders; the first in document order stays.
4. *Apply.* Spans meet their documents.

Triggers with very many distinct contexts (found in a sample of documents, which
decides only where rows go) are not sorted together: their strings are looked up by
hash like contexts are. Rows move as packed arrays, one per task and bucket; the number
of buckets follows the bytes of text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_spark.llm.buffers import (
    BASE, BYTE_CODES, INVERSE, flat_bytes, integers, mix, pieces, powers, release_memory, split_words,
)
from corpus_spark.session import materialize

CORE = 1 << 18
BUCKET_BYTES = 8 << 20
PIECE_BYTES = 4 << 20
LEAST_BUCKETS = 23
HOT_SAMPLE = 256  # one document in so many is looked at for hot triggers
HOT_CONTEXTS = 48  # distinct contexts in the sample that make a trigger hot
HOT_LIMIT = 8192  # hot triggers sent to the tasks, the most frequent first

# A document is told by tag, a hash of id and text; doc, its id, and tag give the order.
_FIRST = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("lo", "<i2"), ("hi", "<i2")])
_SPAN = np.dtype([("tag", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_OPEN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("hot", "<i4")])
_PACKED = "bucket int, kind string, data binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])


@dataclass(frozen=True)
class Unit:
    """What a repeat is made of."""

    words: bool
    length: int
    trigger: int

    @property
    def reach(self) -> int:
        return self.length - self.trigger

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, object]:
        """(symbols, document offsets, words or None)."""
        if not self.words:
            return data, offsets, None
        words = split_words(data, offsets, lower=False)
        return words.hash, words.first.astype(np.int64), words

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.words else BYTE_CODES[symbols]


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every full window."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def triggers(symbols: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(document, place, lo, hi, key, check) of each trigger of a batch.

    The context is lo:hi; key is the hash of the trigger, check that of the context.
    Works in pieces of CORE symbols, so a document may be of any length.
    """
    found = []
    length, reach, n = unit.length, unit.reach, len(symbols)
    margin = 2 * length
    for core in range(0, n, CORE):
        a, b = max(0, core - margin), min(n, core + CORE + margin)
        if b - a < length:
            continue
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(unit.codes(symbols[a:b]) * powers(BASE, b - a), out=total[1:])
        back = powers(INVERSE, b - a + 1)

        def hashed(lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
            return (total[hi] - total[lo]) * back[lo]

        windows = b - a - unit.trigger + 1
        raw = hashed(slice(0, windows), slice(unit.trigger, b - a + 1))
        key = mix(raw) | np.uint64(1)
        least = _sliding(key, reach + 1, np.minimum)
        first, last = np.searchsorted(offsets, [a, b], "right")
        for end in offsets[max(first - 1, 0) : last + 1]:
            least[max(end - length + 1 - a, 0) : max(end - a, 0)] = 0  # strings over a border
        edge = np.zeros(reach, np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), reach + 1, np.maximum)
        hit = np.flatnonzero(most == key)
        hit = hit[(hit + a >= core) & (hit + a < core + CORE)]
        if not len(hit):
            continue
        place = hit + a
        doc = np.searchsorted(offsets, place, "right") - 1
        lo = np.maximum(offsets[doc], place - reach)
        hi = np.minimum(offsets[doc + 1], place + length)
        shape = ((place - lo) * 1024 + (hi - place)).astype(np.uint64)
        context = mix(hashed(lo - a, hi - a) + shape * np.uint64(0xC2B2AE3D27D4EB4F))
        found.append((doc, place - offsets[doc], lo - offsets[doc], hi - offsets[doc], key[hit], context))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _later(rows: np.ndarray) -> np.ndarray:
    """Marks rows, sorted by key, check, doc and at, that have an earlier equal."""
    if not len(rows):
        return np.zeros(0, bool)
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["check"][1:] != rows["check"][:-1])
    head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    return (head["tag"] != rows["tag"]) | (head["at"] != rows["at"])


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["at"], rows["tag"], rows["doc"], rows["check"], rows["key"]))]


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), _SPAN)
    out["tag"] = rows["tag"]
    out["lo"] = rows["at"] + rows["lo"]
    out["hi"] = rows["at"] + rows["hi"]
    return out


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _doc_bucket(tags: np.ndarray, buckets: int) -> np.ndarray:
    """The same number as ``pmod(tag, buckets)`` in Spark."""
    return tags % buckets


def _pack(kind: str, rows: np.ndarray, bucket: np.ndarray, out: list) -> None:
    """Append one packed row per bucket."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, number in zip(np.split(rows, cuts), bucket[np.concatenate([[0], cuts])]):
        out.append((int(number), kind, part.tobytes()))


def _packed(out: list) -> pa.Table:
    columns = list(zip(*out)) or [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PACKED_ARROW)], _PACKED_ARROW)


def _unpack(table: pa.Table, kind: str, dtype: np.dtype) -> np.ndarray:
    kinds = table.column("kind").to_pylist()
    parts = [np.frombuffer(d.as_py(), dtype) for d, k in zip(table.column("data"), kinds) if k == kind]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _first_wins(rows: np.ndarray, buckets: int, out: list) -> np.ndarray:
    """Turn later equals into spans; return the first of each."""
    rows = _sorted(rows)
    later = _later(rows)
    spans = _spans(rows[later])
    _pack("span", spans, _doc_bucket(spans["tag"], buckets), out)
    return rows[~later]


def _parse(unit: Unit, buckets: int, hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, tags = integers(batch.column("id")), integers(batch.column("tag"))
            symbols, offsets, _ = unit.symbols(*flat_bytes(batch.column("text")))
            doc, at, lo, hi, key, check = triggers(symbols, offsets, unit)
            rows = np.empty(len(doc), _FIRST)
            rows["key"], rows["check"], rows["doc"], rows["tag"], rows["at"] = key, check, ids[doc], tags[doc], at
            rows["lo"], rows["hi"] = lo - at, hi - at
            out: list = []
            rows = _first_wins(rows, buckets, out)
            split = np.isin(rows["key"], hot)
            _pack("trigger", rows, _bucket(np.where(split, rows["check"], rows["key"]), buckets), out)
            yield from _packed(out).to_batches()

    return run


def _look_up(buckets: int, hot: np.ndarray) -> Callable:
    """Equal contexts become spans, triggers with one context go, the rest stays open."""

    def run(table: pa.Table) -> pa.Table:
        release_memory()
        out: list = []
        for span in (d.as_py() for d, k in zip(table["data"], table["kind"].to_pylist()) if k == "span"):
            out.append((table["bucket"][0].as_py(), "span", span))
        rows = _first_wins(_unpack(table, "trigger", _FIRST), buckets, out)
        if len(rows):
            same = rows["key"][1:] == rows["key"][:-1]
            many = np.zeros(len(rows), bool)
            many[1:] |= same
            many[:-1] |= same
            split = np.isin(rows["key"], hot)
            rows, split = rows[many | split], split[many | split]
            left = np.empty(len(rows), _OPEN)
            left["doc"], left["tag"], left["at"], left["hot"] = rows["doc"], rows["tag"], rows["at"], split
            _pack("open", left, _doc_bucket(left["tag"], buckets), out)
        return _packed(out)

    return run


def _by_tag(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number in ids, row number in wanted) of all pairs with equal tag."""
    order = np.argsort(wanted, kind="stable")
    sorted_ids = wanted[order]
    lo, hi = np.searchsorted(sorted_ids, ids, "left"), np.searchsorted(sorted_ids, ids, "right")
    doc = np.repeat(np.arange(len(ids)), hi - lo)
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo)
    return doc, order[start + np.arange(len(doc))]


def _context_type(unit: Unit) -> np.dtype:
    kind, reach = ("<u8" if unit.words else "u1"), unit.reach
    return np.dtype([
        ("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("before", "<i2"), ("after", "<i2"),
        ("left", kind, (reach,)), ("right", kind, (reach,)),
    ])


def _contexts(unit: Unit, buckets: int) -> Callable:
    """Fetch what surrounds the open triggers: left is read backwards from the trigger."""
    reach = unit.reach

    def fetch(symbols, place, start, end):
        at = np.arange(1, reach + 1)
        back, ahead = place[:, None] - at, place[:, None] + unit.trigger - 1 + at
        last = max(len(symbols) - 1, 0)
        left = np.where(back >= start[:, None], symbols[np.clip(back, 0, last)], 0)
        right = np.where(ahead < end[:, None], symbols[np.clip(ahead, 0, last)], 0)
        return left, right

    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        release_memory()
        out: list = []
        wanted = _unpack(packed, "open", _OPEN)
        if len(wanted) and docs.num_rows:
            docs = docs.filter(np.isin(integers(docs["tag"]), wanted["tag"]))
        if len(wanted) and docs.num_rows:
            symbols, offsets, _ = unit.symbols(*flat_bytes(docs["text"]))
            row, which = _by_tag(integers(docs["tag"]), wanted["tag"])
            place = offsets[row] + wanted["at"][which]
            fits = place + unit.trigger <= offsets[row + 1]
            row, which, place = row[fits], which[fits], place[fits]
            for cut in range(0, len(row), 1 << 16):
                some = slice(cut, cut + (1 << 16))
                start, end, p = offsets[row[some]], offsets[row[some] + 1], place[some]
                rows = np.zeros(len(p), _context_type(unit))
                rows["left"], rows["right"] = fetch(symbols, p, start, end)
                rows["before"] = np.minimum(reach, p - start)
                rows["after"] = np.minimum(reach, end - p - unit.trigger)
                rows["doc"], rows["tag"] = wanted["doc"][which[some]], wanted["tag"][which[some]]
                rows["at"] = p - start
                rows["key"] = _trigger_hash(symbols, p, unit)
                hot = wanted["hot"][which[some]] == 1
                _pack("context", rows[~hot], _bucket(rows["key"][~hot], buckets), out)
                strings = _strings(rows[hot], unit)
                strings = _first_wins(strings, buckets, out)
                _pack("string", strings, _bucket(strings["key"], buckets), out)
        return _packed(out)

    return run


def _trigger_hash(symbols: np.ndarray, place: np.ndarray, unit: Unit) -> np.ndarray:
    total = np.zeros(len(place), np.uint64)
    scale = powers(BASE, unit.trigger)
    for i in range(unit.trigger):
        total += unit.codes(symbols[place + i]) * scale[i]
    return mix(total) | np.uint64(1)


def _strings(rows: np.ndarray, unit: Unit) -> np.ndarray:
    """Every string through the given triggers, by two hashes."""
    reach, parts = unit.reach, []
    ahead = [np.zeros(len(rows), np.uint64)]
    for i in range(reach):
        ahead.append(mix(ahead[-1] * np.uint64(BASE) + unit.codes(rows["right"][:, i])))
    back = np.zeros(len(rows), np.uint64)
    for depth in range(reach + 1):
        if depth:
            back = mix(back * np.uint64(BASE) + unit.codes(rows["left"][:, depth - 1]))
        fit = (rows["before"] >= depth) & (rows["after"] >= reach - depth)
        one = np.empty(int(fit.sum()), _FIRST)
        one["key"] = mix(rows["key"][fit] + back[fit] * np.uint64(3) + ahead[reach - depth][fit])
        one["check"] = mix(ahead[reach - depth][fit] ^ mix(back[fit] + np.uint64(depth)))
        one["doc"], one["tag"], one["at"] = rows["doc"][fit], rows["tag"][fit], rows["at"][fit] - depth
        one["lo"], one["hi"] = 0, unit.length
        parts.append(one)
    return np.concatenate(parts)


def _ranks(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by key and text; (order, depth shared with the row before, -1 across keys)."""
    n, reach = text.shape
    wide = text.astype(text.dtype.newbyteorder(">")).view(np.uint8).reshape(n, -1)
    whole = np.concatenate([key.astype(">u8").view(np.uint8).reshape(n, 8), wide], axis=1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}").ravel(), kind="stable")
    ordered = text[order]
    differs = np.concatenate([ordered[1:] != ordered[:-1], np.ones((n - 1, 1), bool)], axis=1)
    shared = np.full(n, -1)
    shared[1:] = np.where(key[order][1:] == key[order][:-1], differs.argmax(axis=1), -1)
    return order, shared


def _order(unit: Unit, buckets: int) -> Callable:
    """Find equal strings among contexts through the two orders."""
    reach = unit.reach

    def run(table: pa.Table) -> pa.Table:
        release_memory()
        out: list = []
        number = table["bucket"][0].as_py()
        for span in (d.as_py() for d, k in zip(table["data"], table["kind"].to_pylist()) if k == "span"):
            out.append((number, "span", span))
        _first_wins(_unpack(table, "string", _FIRST), buckets, out)
        rows = _unpack(table, "context", _context_type(unit))
        if len(rows) > 1:
            rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"]))]
            n = len(rows)
            left_order, left_shared = _ranks(rows["key"], rows["left"])
            right_order, right_shared = _ranks(rows["key"], rows["right"])
            deep, flat = np.full(n, -1), np.full(n, reach + 1)
            left, right = np.empty(n, np.int64), np.empty(n, np.int64)
            for depth in range(reach + 1):
                fit = np.flatnonzero((rows["before"] >= depth) & (rows["after"] >= reach - depth))
                left[left_order] = np.cumsum(left_shared < depth)
                right[right_order] = np.cumsum(right_shared < reach - depth)
                both = left[fit] * (n + 1) + right[fit]
                order = np.argsort(both, kind="stable")
                both, fit = both[order], fit[order]
                new = np.ones(len(fit), bool)
                new[1:] = both[1:] != both[:-1]
                head = fit[np.maximum.accumulate(np.where(new, np.arange(len(fit)), 0))] if len(fit) else fit
                later = (rows["tag"][head] != rows["tag"][fit]) | (rows["at"][head] != rows["at"][fit])
                marked = fit[later]
                deep[marked] = depth
                flat[marked] = np.minimum(flat[marked], depth)
            some = deep >= 0
            spans = np.empty(int(some.sum()), _SPAN)
            spans["tag"] = rows["tag"][some]
            spans["lo"] = rows["at"][some] - deep[some]
            spans["hi"] = rows["at"][some] - flat[some] + unit.length
            _pack("span", spans, _doc_bucket(spans["tag"], buckets), out)
        return _packed(out)

    return run


def _covered(sizes: np.ndarray, tags: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by spans: (document row, lo, hi), clipped to the documents."""
    row, which = _by_tag(tags, spans["tag"])
    lo = np.minimum(spans["lo"][which], sizes[row]).astype(np.int64)
    hi = np.minimum(spans["hi"][which], sizes[row]).astype(np.int64)
    row, lo, hi = row[hi > lo], lo[hi > lo], hi[hi > lo]
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[row]  # a gap keeps documents apart
    lo, hi = lo + base, hi + base
    order = np.argsort(lo, kind="stable")
    row, lo, hi, base = row[order], lo[order], np.maximum.accumulate(hi[order]) if len(hi) else hi, base[order]
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:] - 1, [len(lo) - 1]]) if len(lo) else at
    return row[at], lo[at] - base[at], hi[ends] - base[at]


def _apply(unit: Unit, finish: Callable, schema: pa.Schema) -> Callable:
    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        release_memory()
        if not docs.num_rows:
            return schema.empty_table()
        data, offsets = flat_bytes(docs["text"])
        symbols, starts, words = unit.symbols(data, offsets)
        ids = integers(docs["id"])
        runs = _covered(np.diff(starts), integers(docs["tag"]), _unpack(packed, "span", _SPAN))
        return finish(docs, ids, data, offsets, starts, words, runs)

    return run


def bucket_count(docs: DataFrame) -> int:
    """The first prime from one bucket for every BUCKET_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    while any(number % d == 0 for d in range(2, math.isqrt(number) + 1)):
        number += 1
    return number


def _hot(docs: DataFrame, unit: Unit) -> np.ndarray:
    """Triggers with many contexts in a sample of documents; at most HOT_LIMIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, PIECE_BYTES):
            symbols, offsets, _ = unit.symbols(*flat_bytes(batch.column(1)))
            *_, key, check = triggers(symbols, offsets, unit)
            order = np.lexsort((check, key))
            key, check = key[order], check[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
            found, counts = np.unique(key[new], return_counts=True)
            keep = counts > 1
            yield pa.record_batch([pa.array(found[keep].view(np.int64)), pa.array(counts[keep])], ["key", "n"])

    sample = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(HOT_SAMPLE)) == 0)
    counts = sample.coalesce(64).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HOT_CONTEXTS).orderBy(F.desc("n"), "key").limit(HOT_LIMIT)
    return np.array([r[0] for r in top.select("key").collect()], np.int64).view(np.uint64)


def repeated_spans(docs: DataFrame, unit: Unit, finish: Callable, schema: T.StructType, arrow: pa.Schema) -> DataFrame:
    """Run the steps over docs (id long, text, other columns) and finish each bucket of documents.

    ``finish`` gets the documents' table, ids, bytes, offsets, symbol offsets, words and the
    covered runs (document row, lo, hi) in symbols. Rows that agree in id and text are one
    document given more than once. Other texts of one id are documents of their own, in the
    order of a hash; so are rows without an id, which come before all others.
    """
    docs = docs.withColumn("tag", F.xxhash64(F.col("id"), F.col("text").cast("binary")))
    buckets = bucket_count(docs)
    hot = _hot(docs.select("id", "text"), unit)
    parsed = docs.select("id", "tag", "text").mapInArrow(_parse(unit, buckets, hot), _PACKED)
    looked = parsed.groupBy("bucket").applyInArrow(_look_up(buckets, hot), _PACKED)
    looked = materialize(looked, "repeats-looked-up")

    keyed = docs.withColumn("bucket", F.pmod("tag", F.lit(buckets)).cast("int"))
    narrow = keyed.select("bucket", "tag", "text")
    opened = looked.where("kind = 'open'")
    contexts = narrow.groupBy("bucket").cogroup(opened.groupBy("bucket")).applyInArrow(_contexts(unit, buckets), _PACKED)
    ordered = contexts.groupBy("bucket").applyInArrow(_order(unit, buckets), _PACKED)
    spans = looked.where("kind = 'span'").unionByName(ordered)
    return keyed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_apply(unit, finish, arrow), schema)
