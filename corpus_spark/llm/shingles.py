"""Distinct word shingles of texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from corpus_spark.llm.buffers import mix, split_words

SHINGLE = 5


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the offsets of each document's.

    A document with fewer words than a shingle has its whole sequence as the only one;
    a document without words has none.
    """
    counts = np.diff(first)
    docs = len(counts)
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for i in range(size):
        rolled = mix(rolled + hashes[i : len(hashes) - size + 1 + i]) if len(rolled) else rolled
    long = counts >= size
    sizes = np.where(long, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offsets[-1], np.uint64)
    # Starts within full documents: every word but the last size - 1 of each.
    start = np.ones(len(hashes), bool)
    for i in range(1, size):
        last = first[1:][counts >= i] - i
        start[last] = False
    place = np.zeros(offsets[-1], bool)
    place[offsets[:-1][~long & (counts > 0)]] = True
    out[~place] = rolled[start[: len(rolled)]] if len(rolled) else rolled
    for d in np.flatnonzero(~long & (counts > 0)):
        h = np.full(1, counts[d], np.uint64)
        for x in hashes[first[d] : first[d + 1]]:
            h = mix(h * np.uint64(31) + x)
        out[offsets[d]] = h[0]
    return out, offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; A-Z are lower-cased."""
    words = split_words(data, offsets, lower=True)
    hashes, bounds = shingle_hashes(words.hash, words.first, size)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
