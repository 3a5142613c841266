"""SimHash near-dedup: exact comparison of fingerprints in tiles.

A fingerprint has a bit for each bit of XXH64 that is set in more than half of a text's
three-word shingles. Equal fingerprints are one class, so copies cost one row. Two
fingerprints that differ in r bits also differ by at most r, summed over their four
16-bit quarters, in the numbers of bits set. So classes are filed in cells by those four
population counts, cells are cut into tiles of about ``TILE`` fingerprints by a hash, and
a tile meets only the tiles of cells within the radius; all other pairs of tiles are
skipped unseen. A pair of tiles is compared whole with exclusive-or and bit counts.
Of the links found a pair of tiles returns a spanning forest, which joins the same
fingerprints with no more rows than the tiles have.

Rows: a NULL text or one without words has fingerprint zero and is linked like any other.
Every row is a document and comes out once; rows that repeat a doc_id are documents of their
own. A NULL doc_id is never the smallest: a component of such rows alone has a NULL
component_id. Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import LOWER, flat_bytes, pieces, split_words
from corpus_spark.llm.components import components
from corpus_spark.llm.skew import salted_join
from corpus_spark.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 2
TILE = 2048
QUARTERS = 4
_DIGIT = 32  # a quarter has 0 to 16 bits set; with a radius below 8 no step over an edge meets a cell
_CHUNK = 1 << 16  # shingles whose bits are counted at once


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, start, end): the words, lower-cased, with one space between neighbours."""
    size = end - start
    after = np.cumsum(size + 1)
    begin = after - size - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    buffer = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    word = np.ones(len(buffer), bool)
    word[after - 1] = False
    buffer[word] = LOWER[data[np.cumsum(inside[:-1], dtype=np.int8) > 0]]
    return buffer.tobytes(), begin, begin + size


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text."""
    words = split_words(data, offsets, lower=False)
    text, start, end = _joined(data, words.start, words.end)
    out = np.zeros(len(offsets) - 1, np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest, place = xxhash.xxh64_intdigest, np.arange(64, dtype=np.uint64)
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if a == b:
            continue
        n = max(b - a - shingle + 1, 1)
        width = min(shingle, b - a)
        counts = np.zeros(64, np.int64)
        for cut in range(0, n, _CHUNK):
            lo = start[a + cut : a + min(cut + _CHUNK, n)].tolist()
            hi = end[a + cut + width - 1 : a + min(cut + _CHUNK, n) + width - 1].tolist()
            h = np.fromiter((digest(text[i:j], SEED) for i, j in zip(lo, hi)), np.uint64, len(lo))
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out[d] = weight[place[2 * counts > n].astype(np.int64)].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = fingerprints(*flat_bytes(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _cell(fp: Column) -> Column:
    """The population counts of the quarters as one number."""
    bits = 64 // QUARTERS
    parts = [F.bit_count(F.shiftrightunsigned(fp, bits * i).bitwiseAND(F.lit((1 << bits) - 1))) for i in range(QUARTERS)]
    cell = parts[0]
    for i, part in enumerate(parts[1:], 1):
        cell = cell + part * _DIGIT**i
    return cell.cast("int")


def cell_steps(radius: int) -> list[int]:
    """Steps from a cell to those within the radius, each pair of cells from one side only."""
    steps = {
        sum(x * _DIGIT**i for i, x in enumerate(move))
        for move in product(range(-radius, radius + 1), repeat=QUARTERS)
        if sum(map(abs, move)) <= radius
    }
    return sorted(s for s in steps if s >= 0)


def forest(u: np.ndarray, v: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links (u, v) connect."""
    label = np.arange(nodes)
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], least)
        np.minimum.at(after, label[v], least)
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == label).all():
            node = np.flatnonzero(label != np.arange(nodes))
            return node, label[node]
        label = after


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between two tiles, or within one if b is None, as a forest."""
    other = a if b is None else b
    near = np.bitwise_count(a[:, None] ^ other) <= radius
    if b is None:
        near &= np.tri(len(a), k=-1, dtype=bool)
    u, v = np.nonzero(near)
    both = a if b is None else np.concatenate([a, b])
    if b is not None:
        v = v + len(a)
    if len(u) > len(both):
        u, v = forest(u, v, len(both))
    return both[u], both[v]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            same, left, right = (batch.column(n) for n in ("same", "left", "right"))
            for i in range(batch.num_rows):
                a = left[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = None if same[i].as_py() else right[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                u, v = tile_links(a, b, radius)
                if len(u):
                    found.append((u, v))
            if found:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints ``fp`` within the radius."""
    if not 0 <= radius < 8:
        raise ValueError("the radius must be from 0 to 7")
    filed = classes.select("fp", _cell(F.col("fp")).alias("cell"))
    # At most 17 ** 4 cells, whatever the size of the table.
    cells = filed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    cells = F.broadcast(materialize(cells, "simhash-cells"))
    number = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = filed.join(cells, "cell").groupBy("cell", number.alias("tile")).agg(F.collect_list("fp").alias("data"))
    tiles = materialize(tiles, "simhash-tiles")
    steps = F.array(*[F.lit(s) for s in cell_steps(radius)])
    moved = tiles.select(
        F.col("cell").alias("home"), F.col("tile").alias("of"), F.col("data").alias("left"), F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("cell")
    )
    met = moved.join(cells, "cell").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.where((F.col("cell") != F.col("home")) | (F.col("tile") >= F.col("of")))
    pairs = met.join(tiles.select("cell", "tile", F.col("data").alias("right")), ["cell", "tile"])
    same = (F.col("cell") == F.col("home")) & (F.col("tile") == F.col("of"))
    return pairs.select(same.alias("same"), "left", "right").mapInArrow(_compare(radius), "u long, v long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) of every row.

    component_id is the smallest doc_id reachable over links, itself included; n_copies
    counts the rows with this fingerprint.
    """
    found = materialize(with_fingerprints(docs, id_col, text_col), "simhash")
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    classes = materialize(classes, "simhash-classes")
    member = components(fingerprint_links(classes, radius, tile))
    member = materialize(
        classes.join(member.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least"), "simhash-members"
    )
    # The component's least node is a fingerprint; what is wanted is the least doc_id.
    root = classes.select(F.col("fp").alias("component"), F.col("least"))
    heads = member.select("component").distinct().join(root, "component").unionByName(member.select("component", "least"))
    heads = heads.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = salted_join(member.select("fp", "component"), heads, ["component"], F.xxhash64("fp"))
    linked = linked.select("fp", "component_id").unionByName(heads.select(F.col("component").alias("fp"), "component_id"))
    several = classes.join(linked, "fp", "left").where("n_copies > 1 or component_id is not null")
    several = several.select("fp", "n_copies", F.coalesce("component_id", "least").alias("component_id"))
    out = salted_join(found, several, ["fp"], F.monotonically_increasing_id(), "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("n_copies").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
