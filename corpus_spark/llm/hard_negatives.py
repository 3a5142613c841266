"""Hard-negative mining by coordinate pruning in length buckets.

Components are scaled to integers, so scores (inner products) are exact. Rows are cut by
length into shards, shards into buckets of ``BUCKET`` rows; a bucket holds for each
coordinate its normalised values in order. An anchor that needs a score of at least t
skips a bucket whose longest row cannot reach it. Else t gives the least cosine any row of
the bucket needs, and for each focus coordinate of the anchor (its largest ones) the range
of values that such a row can have. The ranges, looked up in the sorted lists, intersect to
the candidates, and those alone are scored.

Two searches run like this: the best rows of the anchor's label (positives), then for each
positive score P the best rows of other labels between the least share of P and P itself.
Both start with the longest rows; the bounds found there prune the rest. Anchors are
matched with all shards in chunks, so a task holds one chunk and one shard.

Of rows with one label and one vector only the six smallest ids can be among the first
five others of any row, so all further copies go before rows are matched; ties by id come out
as if they were there.

Rows: a NULL label or vector, a NULL or non-finite component, or one of 2**20 or more in
size (products would leave 64 bits) takes no part. Shorter vectors count as padded with
zeros. Rows that repeat an id are rows of their own. A NULL id is no anchor, keeps its
label and sorts first. Other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import id_array, integers
from corpus_spark.session import materialize

EVERY = 100  # ids of anchors are its multiples
POSITIVES = 5
NEGATIVES = 5
LEAST_SHARE = (4, 5)  # of the positive's score, that a negative reaches
SCALE = 256
LIMIT = 2**20
BUCKET = 2048
SHARD_ROWS = 8192
CHUNK = 8192  # anchors that meet a shard in one task
FOCUS = 4
_SLACK = 1e-9


class Bucket:
    """Rows of similar length with a sorted list of normalised values for each coordinate."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, vectors: np.ndarray):
        self.row, self.ids, self.label, self.vectors = row, ids, label, vectors
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T
        self.values = np.take_along_axis(unit, self.order.T, axis=0).T
        largest = float(np.abs(vectors).max(initial=0))
        self.small = largest * largest * vectors.shape[1] < 2**53
        self.floats = vectors.astype(float) if self.small else None

    def candidates(self, anchor: np.ndarray, length: float, least: int | None, focus: int = FOCUS) -> np.ndarray:
        """Flags of the rows that may score at least ``least``; all of them if that is None."""
        n = len(self.row)
        if least is None or least <= 0:
            return np.ones(n, bool)
        most = length * self.longest
        if most * (1 + _SLACK) < least:
            return np.zeros(n, bool)
        angle = np.arccos(min(1.0, least / most)) + 1e-6
        unit = anchor / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            axis = np.arccos(np.clip(unit[f], -1, 1))
            lo, hi = np.cos(min(np.pi, axis + angle)), np.cos(max(0.0, axis - angle))
            a, b = np.searchsorted(self.values[f], [lo - _SLACK, hi + _SLACK])
            ranges.append((b - a, f, a, b))
        found = None
        for _, f, a, b in sorted(ranges):
            one = np.zeros(n, bool)
            one[self.order[f, a:b]] = True
            found = one if found is None else found & one
        return found

    def scores(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.small and float(np.abs(anchor).max(initial=0)) < LIMIT and 2 * at.size > len(self.row):
            bound = float(np.abs(anchor).max(initial=0)) * float(np.abs(self.floats).max(initial=0)) * len(anchor)
            if bound < 2**53:
                return (self.floats @ anchor.astype(float)).astype(np.int64)[at]
        return self.vectors[at] @ anchor


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def buckets(table: pa.Table, width: int, size: int) -> list[Bucket]:
    """The rows of a table cut by falling length."""
    vectors = _vectors(table["vec"], width)
    row, ids, label = table["row"].to_numpy(), integers(table["id"]), table["label"].to_numpy()
    order = np.lexsort((row, -(vectors.astype(float) ** 2).sum(axis=1)))
    return [Bucket(row[o], ids[o], label[o], vectors[o]) for o in (order[a : a + size] for a in range(0, len(order), size))]


def _least(score: int) -> int:
    """The smallest score that counts as a negative of a positive with ``score``."""
    share, whole = LEAST_SHARE
    return -(-share * score // whole)


def _merge(kept: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([kept[0], score]), np.concatenate([kept[1], ids])
    order = np.lexsort((ids, -score))
    return score[order], ids[order]


def best_positives(parts: list[Bucket], anchor: tuple, known: int | None, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the best ``count`` rows of the anchor's label that may beat ``known``."""
    row, label, vector, length = anchor
    kept, least = (np.zeros(0, np.int64), np.zeros(0, np.int64)), known
    for part in parts:
        fits = part.candidates(vector, length, least) & (part.label == label) & (part.row != row)
        at = np.flatnonzero(fits)
        score = part.scores(vector, at)
        good = slice(None) if least is None else score >= least
        kept = tuple(x[:count] for x in _merge(kept, score[good], part.ids[at][good]))
        if len(kept[0]) == count:
            least = int(kept[0][-1]) if least is None else max(least, int(kept[0][-1]))
    return kept


def best_negatives(parts: list[Bucket], anchor: tuple, wanted: list[tuple[int, int | None]], count: int) -> list[tuple]:
    """(positive score, scores, ids) for each wanted (positive score, known least score)."""
    _, label, vector, length = anchor
    floors = {p: max(_least(p), _least(p) if known is None else known) for p, known in wanted if p >= 0}
    if not floors:
        return []
    top, kept = max(floors), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found: list[tuple] = []
    for part in parts:
        at = np.flatnonzero(part.candidates(vector, length, min(floors.values())) & (part.label != label))
        score = part.scores(vector, at)
        good = (score <= top) & (score >= min(floors.values()))
        kept = _merge(kept, score[good], part.ids[at][good])
        found, stay = [], np.zeros(len(kept[0]), bool)
        for p in floors:
            lo = int(np.searchsorted(-kept[0], -p, "left"))
            hi = min(lo + count, int(np.searchsorted(-kept[0], -floors[p], "right")))
            found.append((p, kept[0][lo:hi], kept[1][lo:hi]))
            stay[lo:hi] = True
            if hi - lo == count:
                floors[p] = max(floors[p], int(kept[0][hi - 1]))
        kept = (kept[0][stay], kept[1][stay])
    return found


_FOUND = pa.schema([("row", pa.int64()), ("p", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _search(width: int, bucket: int, positives: int | None, negatives: int) -> Callable:
    """A chunk of anchors against a shard, for the best positives or, if that is None, the negatives."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        parts = buckets(rows, width, bucket)
        vectors = _vectors(anchors["vec"], width)
        lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        row, label, wanted = anchors["row"].to_numpy(), anchors["label"].to_numpy(), anchors["wanted"].to_pylist()
        out: list = []
        for i in range(len(row)):
            anchor = (row[i], label[i], vectors[i], float(lengths[i]))
            if positives is not None:
                known = wanted[i][0]["known"] if wanted[i] else None
                found = [(0, *best_positives(parts, anchor, known, positives))]
            else:
                found = best_negatives(parts, anchor, [(w["p"], w["known"]) for w in wanted[i]], negatives)
            out += [(np.full(len(s), row[i]), np.full(len(s), p), s, ids) for p, s, ids in found if len(s)]
        if not out:
            return _FOUND.empty_table()
        at, p, score, ids = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(at), pa.array(p), pa.array(score), id_array(ids)], schema=_FOUND)

    return run


def integer_rows(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(row, id, label, vec) of the rows that take part, written once."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    source = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), doubles.alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    source = source.where(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    vec = F.transform("x", lambda x: F.floor(x * SCALE).cast("bigint"))
    return materialize(source.select(F.monotonically_increasing_id().alias("row"), "id", "label", vec.alias("vec")), "vectors")


def _ranked(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each anchor (and positive score), with their rank."""
    place = F.row_number().over(Window.partitionBy("row", "p").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    bucket: int = BUCKET, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (row, id, label, vec)."""
    spark = rows.sparkSession
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    copies = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id", "row"))
    kept = rows.withColumn("copy", copies).where(F.col("copy") <= max(positives, negatives) + 1).drop("copy")
    total = rows.count()
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    parts = max(1, -(-total // shard_rows))
    dealt = kept.withColumn("square", square).repartitionByRange(parts, F.desc("square"), "row")
    shards = materialize(dealt.drop("square").withColumn("shard", F.spark_partition_id()), "vector-shards")
    anchors = rows.where(F.col("id") % every == 0)
    chunks = max(1, -(-anchors.count() // chunk))
    anchors = materialize(anchors.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")), "anchors")
    # One number for each shard; the first holds the longest rows.
    numbers = sorted(r[0] for r in shards.select("shard").distinct().collect())
    if not numbers:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def match(asking: DataFrame, which: list[int], count: int | None) -> DataFrame:
        """Every anchor in ``asking`` against the shards in ``which``."""
        left = asking.withColumn("to", F.explode(F.sequence(F.lit(which[0]), F.lit(which[-1]))))
        right = shards.where(F.col("shard").between(which[0], which[-1])).select(
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("part"), "shard", F.col("row"), "id", "label", "vec"
        )
        both = left.groupBy("chunk", "to").cogroup(right.groupBy("part", "shard"))
        return both.applyInArrow(_search(width, bucket, count, negatives), "row long, p long, score long, id long")

    def search(asking: DataFrame, bounds: Callable[[DataFrame | None], DataFrame], count: int | None, keep: int) -> DataFrame:
        """The longest rows first, then the rest with the bounds found there."""
        first = materialize(match(bounds(None), numbers[:1], count), "search-first")
        if len(numbers) == 1:
            return first
        return materialize(first.unionByName(match(bounds(first), numbers[1:], count)), "search-all")

    def known(found: DataFrame, keep: int) -> DataFrame:
        return _ranked(found, keep).where(F.col("rank") == keep).select("row", "p", F.col("score").alias("known"))

    asked = "array<struct<p: long, known: long>>"

    def for_positives(found: DataFrame | None) -> DataFrame:
        if found is None:
            return anchors.withColumn("wanted", F.array().cast(asked))
        bound = known(found, positives).select("row", F.array(F.struct("p", "known")).alias("wanted"))
        return anchors.join(bound, "row", "left").withColumn("wanted", F.coalesce("wanted", F.array().cast(asked)))

    chosen = materialize(_ranked(search(anchors, for_positives, positives, positives), positives), "positives")
    scores = chosen.select("row", F.col("score").alias("p")).where("p >= 0").distinct()

    def for_negatives(found: DataFrame | None) -> DataFrame:
        if found is None:
            listed = scores.withColumn("known", F.lit(None).cast("bigint"))
        else:
            listed = scores.join(known(found, negatives), ["row", "p"], "left")
        listed = listed.groupBy("row").agg(F.collect_list(F.struct("p", "known")).alias("wanted"))
        return anchors.join(listed, "row")

    mined = _ranked(search(anchors, for_negatives, None, negatives), negatives)
    mined = mined.select("row", "p", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = chosen.select("row", F.col("score").alias("p"), F.col("id").alias("positive_id"))
    pairs = pairs.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return mined.join(pairs, ["row", "p"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score"
    )


def shifted_labels(rows: DataFrame) -> DataFrame:
    """The label of every row whose id is divisible by 7 becomes (label + 1) % 10."""
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", shifted)


def hard_negatives_sql() -> str:
    """The same for the table ``embeddings``, whose ids are unique and whose vectors are equally long."""
    share, whole = LEAST_SHARE
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         list_inner_product(a.x::DOUBLE[], r.x::DOUBLE[])::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % {EVERY} = 0 AND r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {share} * positive_score <= {whole} * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
