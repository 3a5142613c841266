"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes that separate words: space, tab, LF, VT, FF, CR.
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

_random = np.random.default_rng(20240607)
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1024)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        with np.errstate(over="ignore"):
            known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; NULL counts as the smallest number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    """The way back: the smallest number is NULL."""
    return pa.array(ids, pa.int64(), mask=ids == -(2**63))


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        kind = column.type
        column = column.combine_chunks() if column.num_chunks else pa.array([], kind)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)
    offsets = offsets[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed arrays back to the machine: a worker outlives its task and would keep them beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int | str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``size`` bytes of a text column (or one row), to bound what a task holds."""
    for batch in batches:
        release_memory()
        texts = batch.column(column)
        if not len(texts):
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, texts, ends
    release_memory()


@dataclass
class Words:
    """Words of a batch: byte start, byte end and hash of each; doc d owns first[d]:first[d+1]."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


BLOCK = 1 << 20


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool, separators: np.ndarray = _SEPARATORS) -> Words:
    """Maximal runs of non-separators within each text; a word's hash covers all its bytes."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begin[cuts] = inside[cuts]
    start = np.flatnonzero(begin)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:][inside] = True
    stop[:-1][inside] = False
    stop[cuts] |= np.where(cuts > 0, inside[cuts - 1], False)
    end = np.flatnonzero(stop)
    del inside, begin, stop
    first = np.searchsorted(start, offsets)
    table = BYTE_CODES[LOWER] if lower else BYTE_CODES
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK)))
        lo, hi = int(start[at]), int(end[to - 1])
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data[lo:hi]] * powers(BASE, hi - lo), out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        back = powers(INVERSE, hi - lo + 1)[s]
        hashes[at:to] = mix((total[e] - total[s]) * back + (e - s).astype(np.uint64) * np.uint64(BASE))
        at = to
    return Words(start, end, hashes, first)


def strip_punctuation(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray = PUNCTUATION, right: np.ndarray = PUNCTUATION
) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends; ``left`` and ``right`` say what goes."""
    if not len(data):
        return start, end
    index = np.arange(len(data), dtype=np.int32 if len(data) < 2**31 else np.int64)
    following = np.minimum.accumulate(np.where(left[data], index.dtype.type(len(data)), index)[::-1])[::-1]
    start = np.minimum(following[start], end).astype(np.int64)
    before = np.maximum.accumulate(np.where(right[data], index.dtype.type(-1), index))
    return start, np.maximum(before[end - 1].astype(np.int64) + 1, start)
