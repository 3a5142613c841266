"""Approximate nearest neighbours along shifted space-filling curves.

Largest inner product becomes nearest direction: vectors are scaled by the largest norm
and get one more coordinate that makes them unit vectors. Each of CURVES curves projects
them with its own rotation to DIMS coordinates, shifts them, cuts every coordinate into
2**BITS even steps and numbers the cells along a Hilbert curve. Keys are range-partitioned
into blocks of about BLOCK_ROWS vectors. A query meets the blocks around its own key on
every curve; what the windows find is scored on the original vectors and merged.

How wide the windows must be depends on the data, so it is fitted: the nearest
neighbours of SAMPLE queries are found by brute force, and the width is the least that
reaches FITTED_RECALL of them on some curve. Vectors without structure, where any window
is as good as another, get wide windows. The steps and block borders come from at most
BORDER_ROWS vectors of the table; every vector is indexed.

Equal vectors are indexed once, with their smallest ids, so that a vector that fills a third of the
table is one entry.

Rows: vectors that are NULL, empty, zero or hold NULL or non-finite components take no
part, nor do vectors of another length than most. NULL ids take no part. A repeated id
with one vector counts once; with different vectors, its best score counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import flat_bytes
from corpus_spark.session import materialize

CURVES, DIMS, BITS = 4, 6, 8
BLOCK_ROWS = 16_384  # a query gets a row for each hit of each block, so blocks are large
SAMPLE = 64
FITTED_RECALL = 0.97
BORDER_ROWS = 16_384
_SEED = 7


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cell numbers below 2 ** bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Fitted rotations, steps, shifts and block borders; its size does not grow with the rows."""

    rotations: list[np.ndarray]
    steps: list[np.ndarray]
    shifts: list[np.ndarray]
    borders: list[np.ndarray]
    scale: float
    reach: list[int]

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose angles follow the inner product."""
        if query:
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            return np.concatenate([unit, np.zeros((len(x), 1))], axis=1)
        y = x / self.scale
        rest = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1, keepdims=True)))
        return np.concatenate([y, rest], axis=1)

    def keys(self, x: np.ndarray, curve: int, query: bool) -> np.ndarray:
        flat = self.lifted(x, query) @ self.rotations[curve]
        steps = self.steps[curve]
        cells = np.stack([np.searchsorted(steps[:, d], flat[:, d]) for d in range(flat.shape[1])], axis=1)
        cells = (cells + self.shifts[curve]) & ((1 << BITS) - 1)
        return hilbert_index(cells, BITS)

    def block(self, x: np.ndarray, curve: int, query: bool) -> np.ndarray:
        return np.searchsorted(self.borders[curve], self.keys(x, curve, query), "right")


def _valid(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors as doubles) of the usable rows of a batch (id, vector)."""
    ids, lists = batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))
    fits = pa.compute.and_(pa.compute.equal(pa.compute.list_value_length(lists), size), pa.compute.is_valid(ids))
    keep = pa.compute.fill_null(fits, False)
    ids, lists = ids.filter(keep), lists.filter(keep)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), size)  # NULL becomes NaN
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.cast(pa.int64()).to_numpy(zero_copy_only=False)[good], x[good] + 0.0


def _distinct(size: int, keep: int, divisor: int):
    """Per batch: each vector once, with its ``keep`` smallest ids and whether a query has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _valid(batch, size)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            packed = np.ascontiguousarray(x).view(f"V{8 * size}").ravel() if len(x) else np.zeros(0, "V8")
            known: dict[bytes, list] = {}
            asked: dict[bytes, bool] = {}
            for i, v in zip(ids.tolist(), packed.tolist()):
                few = known.setdefault(v, [])
                if len(few) < keep and (not few or few[-1] != i):
                    few.append(i)
                asked[v] = asked.get(v, False) or i % divisor == 0
            yield pa.record_batch(
                [pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.list_(pa.int64())), pa.array(list(asked.values()), pa.bool_())],
                ["vector", "ids", "asked"],
            )

    return run


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    data, _ = flat_bytes(column)
    return np.frombuffer(data.tobytes(), np.float64).reshape(-1, size)


def _best(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score): at least the k best rows of each query, ties included."""
    found = []
    for lo in range(0, len(queries), 256):
        score = queries[lo : lo + 256] @ rows.T
        if score.shape[1] > k:
            edge = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
            q, r = np.nonzero(score >= edge - 1e-12 * np.abs(edge))
        else:
            q, r = np.nonzero(np.ones_like(score, bool))
        # One order of summation whatever the block, so that a pair always scores the same.
        found.append((q + lo, r, np.einsum("ij,ij->i", queries[q + lo], rows[r])))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(_SEED), "vector"), "vector").limit(n)


def _fit(index: DataFrame, size: int, k: int) -> Curves | None:
    """Fit curves, borders and the window of each curve."""
    norm = _norms(index, size)
    count = index.count()
    sample = [r["vector"] for r in _sampled(index, BORDER_ROWS).select("vector").collect()]
    asked = [r["vector"] for r in _sampled(index.where("asked"), SAMPLE).select("vector").collect()]
    if not sample or not asked:
        return None
    x = np.frombuffer(b"".join(sample), np.float64).reshape(-1, size)
    queries = np.frombuffer(b"".join(asked), np.float64).reshape(-1, size)
    random = np.random.default_rng(_SEED)
    curves = Curves([], [], [], [], norm, [])
    blocks = max(1, math.ceil(count / BLOCK_ROWS))
    dims = min(DIMS, size + 1)
    for c in range(CURVES):
        turn, _ = np.linalg.qr(random.standard_normal((size + 1, size + 1)))
        curves.rotations.append(turn[:, :dims])
        flat = curves.lifted(x, False) @ turn[:, :dims]
        curves.steps.append(np.quantile(flat, np.arange(1, 1 << BITS) / (1 << BITS), axis=0))
        curves.shifts.append(random.integers(0, 1 << BITS, dims))
        keys = np.sort(curves.keys(x, c, False))
        curves.borders.append(np.unique(np.quantile(keys, np.arange(1, blocks) / blocks, method="lower").astype(np.int64)))
    truth, near = _truth(index, queries, size, k)
    apart = np.stack([np.abs(curves.block(queries[truth], c, True) - curves.block(near, c, False)) for c in range(CURVES)])
    # A row counts as found where some curve has it within the same share of its blocks.
    share = (apart / np.array([[len(b) + 1] for b in curves.borders])).min(axis=0)
    wanted = float(np.quantile(share, FITTED_RECALL, method="higher")) if len(share) else 0.0
    curves.reach = [max(1, math.ceil(wanted * (len(b) + 1) - 1e-9)) for b in curves.borders]
    return curves


def _norms(index: DataFrame, size: int) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), size)
            yield pa.record_batch([pa.array([float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))])], ["norm"])

    return index.select("vector").mapInArrow(run, "norm double").agg(F.max("norm")).first()[0] or 1.0


def _truth(index: DataFrame, queries: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, vector) of the k nearest vectors of each of SAMPLE queries, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, r, score = _best(queries, _matrix(batch.column(0), size), k + 1)
            yield pa.record_batch([pa.array(q.astype(np.int32)), batch.column(0).take(pa.array(r)), pa.array(score)], ["q", "vector", "score"])

    rows = index.select("vector").mapInArrow(run, "q int, vector binary, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vector")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).collect()
    own = [bytes(v) for v in (q.tobytes() for q in queries)]
    best = [r for r in best if bytes(r["vector"]) != own[r["q"]]]
    vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in best), np.float64).reshape(-1, size)
    return np.array([r["q"] for r in best], np.int64), vectors


def _placed(curves: Curves, size: int):
    """Every vector once per curve, every query once per block of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), size)
            asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            for c in range(CURVES):
                block = curves.block(x, c, False)
                yield _rows(batch, np.arange(len(x)), np.full(len(x), c), block, False)
                if len(asked):
                    top = len(curves.borders[c])
                    centre = curves.block(x[asked], c, True)
                    lo, hi = np.maximum(centre - curves.reach[c], 0), np.minimum(centre + curves.reach[c], top)
                    which = np.repeat(asked, hi - lo + 1)
                    start = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo + 1)[:-1]]), hi - lo + 1)
                    blocks = start + np.arange(len(which))
                    for cut in range(0, len(which), 10_000):
                        some = slice(cut, cut + 10_000)
                        yield _rows(batch, which[some], np.full(len(which[some]), c), blocks[some], True)

    return run


def _rows(batch: pa.RecordBatch, which: np.ndarray, curve: np.ndarray, block: np.ndarray, query: bool) -> pa.RecordBatch:
    n = len(which)
    ids = pa.nulls(n, pa.list_(pa.int64())) if query else batch.column("ids")
    which = pa.array(which)
    columns = [pa.array(curve, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(n, query)), ids]
    columns += [batch.column(c).take(which) for c in ("vector", "h1", "h2")]
    return pa.record_batch(columns, ["curve", "block", "query", "ids", "vector", "h1", "h2"])


def _searched(size: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(table["query"])
        rows = table.filter(pa.compute.invert(table["query"]))
        q, r, score = _best(_matrix(asked["vector"], size), _matrix(rows["vector"], size), k)
        q = pa.array(q)
        return pa.table({"h1": asked["h1"].take(q), "h2": asked["h2"].take(q), "ids": rows["ids"].take(pa.array(r)), "score": pa.array(score)})

    return run


def _marks() -> list[Column]:
    """Two hashes that stand for a vector where rows are many."""
    return [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")]


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_divisor: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``query_divisor`` its k best other ids."""
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return empty
    size, keep = common["n"], k + 1
    each = rows.mapInArrow(_distinct(size, keep, query_divisor), "vector binary, ids array<long>, asked boolean")
    merged = each.groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.max("asked").alias("asked"))
    few = F.slice(F.array_sort(F.array_distinct("ids")), 1, keep)
    index = materialize(merged.select("vector", few.alias("ids"), "asked", *_marks()), "vectors")
    curves = _fit(index, size, k)
    if curves is None:
        return empty
    placed = index.mapInArrow(_placed(curves, size), "curve int, block int, query boolean, ids array<long>, vector binary, h1 long, h2 long")
    found = placed.groupBy("curve", "block").applyInArrow(_searched(size, keep), "h1 long, h2 long, ids array<long>, score double")
    pairs = found.select("h1", "h2", F.explode("ids").alias("vec_id"), "score")
    pairs = pairs.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    by_vector = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= keep).drop("rank")
    asked = rows.where((F.col("id") % query_divisor == 0) & (F.size("v") == size)).mapInArrow(_asked(size), "query_id long, vector binary")
    results = asked.select("query_id", *_marks()).distinct().join(best, ["h1", "h2"]).where("query_id <> vec_id")
    results = results.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _asked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _valid(batch, size)
            yield pa.record_batch([pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "vector"])

    return run
