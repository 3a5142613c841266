"""MinHash near-dedup with circulant permutations.

Two permutations make every signature coordinate: the first scatters the shingles over
2**32 places, the second ranks the places, and coordinate k ranks them shifted by k round
the circle. 128 coordinates make 32 bands of 4; a pair with similarity 0.75 shares no
band with probability 6e-6.

Texts with equal shingle sets count once. In each band bucket every text is verified
against the bucket's first one; components follow from the links found. Texts of one
bucket that are still in different components are then compared by their whole
signatures, inside a task. Where these agree in 56 % of the coordinates, one text visits
the other's component and is compared with all of it. So a large group of copies costs a
row for each text, and a link between different texts is not lost for want of a partner. Links are confirmed on full shingle sets.

Rows: a NULL text or one without words has an empty set and is linked with nothing. Rows
that repeat a doc_id are one document, and the smallest of its sets counts. Rows with a
NULL id are one document too, before all others. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import flat_bytes, mix, pieces, split_words
from corpus_spark.llm.components import components
from corpus_spark.llm.shingles import SHINGLE, shingle_hashes, shingle_sets
from corpus_spark.llm.skew import may_hold
from corpus_spark.session import materialize

BANDS, ROWS = 32, 4
PERCENT = 75
SALT_ROWS = 1000  # texts compared with one partner in one group
PART_ROWS = 2000  # texts of a bucket compared with the others in one group
ESTIMATE = 0.56
_CHUNK = 1 << 15

_A, _B = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)


def _scatter(hashes: np.ndarray) -> np.ndarray:
    """The first permutation, on the 32-bit universe the shingles are folded to."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def circulant_signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """One row per document with at least one shingle; hashes may repeat within a document."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), coordinates), np.uint32)
    place = _scatter(hashes)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        lo = int(starts[at])
        hi = int(starts[to]) if to < len(starts) else len(hashes)
        x, cut = place[lo:hi], starts[at:to] - lo
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.add(x, np.uint32(k), out=y)  # the circular shift
            np.right_shift(y, np.uint32(16), out=z)  # the second permutation
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _A, out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, _B, out=y)
            np.right_shift(y, np.uint32(16), out=z)
            np.bitwise_xor(y, z, out=y)
            out[at:to, k] = np.minimum.reduceat(y, cut)
        at = to
    return out


def _band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """The low 16 bits of a band's four coordinates, side by side in one long."""
    low = (signatures & np.uint32(0xFFFF)).astype("<u2")
    return np.ascontiguousarray(low).view("<i8").reshape(len(signatures), bands)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: size of the set, two hashes of the whole set, band keys."""
    for batch in pieces(batches, 1, 1 << 20):
        data, offsets = flat_bytes(batch.column(1))
        words = split_words(data, offsets, lower=True)
        hashes, bounds = shingle_hashes(words.hash, words.first)
        signatures = circulant_signatures(hashes, bounds, BANDS * ROWS)
        keys = _band_keys(signatures, BANDS)
        some = np.flatnonzero(np.diff(bounds) > 0)
        size = np.zeros(batch.num_rows, np.int64)
        one, two = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        for d in some.tolist():
            part = np.unique(hashes[bounds[d] : bounds[d + 1]])
            size[d], one[d] = len(part), part.sum()
            two[d] = np.bitwise_xor.reduce(mix(part + np.uint64(77)))
        of = np.zeros(batch.num_rows + 1, np.int32)
        of[1:][some] = BANDS
        bands = pa.ListArray.from_arrays(pa.array(np.cumsum(of), pa.int32()), pa.array(keys.ravel()))
        yield pa.record_batch(
            [batch.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), bands],
            ["id", "n", "h1", "h2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text by its packed shingle set."""
    for batch in pieces(batches, "text", 1 << 20):
        sets = shingle_sets(*flat_bytes(batch.column("text")))
        wanted = [h == int(s.sum().view(np.int64)) for h, s in zip(batch.column("h1").to_pylist(), sets)]
        packed = pa.array([s.tobytes() for s in sets], pa.binary())
        yield pa.record_batch([batch.column("id"), packed], ["id", "shingles"]).filter(pa.array(wanted, pa.bool_()))


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Members of a bucket against the centre of their group."""
        table = table.sort_by([("centre", "ascending"), ("part", "ascending"), ("member", "ascending")])
        centre, part = table["centre"].to_numpy(), table["part"].to_numpy()
        member = table["member"].to_numpy()
        data, offsets = flat_bytes(table["shingles"])
        found = []
        cuts = np.flatnonzero((np.diff(centre) != 0) | (np.diff(part) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(centre)]):
            own = [r for r in range(lo, hi) if member[r] == centre[r]]
            if not own:
                continue
            base = data[offsets[own[0]] : offsets[own[0] + 1]].view(np.uint64)
            for r in range(lo, hi):
                if member[r] == centre[r]:
                    continue
                other = data[offsets[r] : offsets[r + 1]].view(np.uint64)
                if not len(base) or not len(other):
                    continue
                at = np.minimum(np.searchsorted(base, other), len(base) - 1)
                shared = int((base[at] == other).sum())
                if 100 * shared >= percent * (len(base) + len(other) - shared):
                    found.append((int(member[r]), int(centre[r])))
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _shingles_of(roles: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, shingles) of the texts that are named in ``roles``."""
    needed = materialize(roles.select("id").distinct().join(members.select("id", "h1"), "id"), "needed")
    named, _ = may_hold(docs, "id", needed, "id")
    return named.join(needed, "id").select("id", "text", "h1").mapInArrow(_sets, "id long, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (member, centre). A centre with many members is dealt to several groups."""
    pairs = materialize(pairs, "candidate-pairs")
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("parts"))
    dealt = pairs.join(parts, "centre").select(
        "centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "member"
    )
    own = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("member"))
    roles = dealt.unionByName(own).withColumnRenamed("member", "id")
    sets = _shingles_of(roles, docs, members)
    bucket = F.pmod(F.xxhash64("centre", "part"), F.lit(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    rows = roles.join(sets, "id").select(bucket.alias("bucket"), "centre", "part", F.col("id").alias("member"), "shingles")
    return materialize(rows.groupBy("bucket").applyInArrow(_confirm(percent), "u long, v long"), "links")


def _alike(percent: int):
    """Pairs of a bucket in different components whose signatures agree well enough.

    ESTIMATE lies 5 standard deviations of 128 coordinates below the threshold, so that it
    loses fewer pairs than the banding. A pair counts only in the first of the bands that it shares. Named are the visitor and the
    component that it must be compared with, once however many of its texts are alike.
    """
    least = round(ESTIMATE * percent / PERCENT * BANDS * ROWS)

    def run(table: pa.Table) -> pa.Table:
        found = set()
        table = table.sort_by([("b", "ascending"), ("key", "ascending"), ("part", "ascending"), ("id", "ascending")])
        columns = [table[c].to_numpy() for c in ("b", "key", "part", "id", "n", "component")]
        b, key, part, ids, n, component = columns
        left, right = (table[c].to_numpy().astype(bool) for c in ("own", "rest"))
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        coordinates = keys.view("<u2").reshape(len(keys), BANDS * ROWS)
        cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            rows, others = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(right[lo:hi])
            for at in range(0, len(others), 32):
                some = others[at : at + 32]
                x, y = np.nonzero(
                    (component[some][:, None] != component[rows])
                    & (100 * n[some][:, None] >= percent * n[rows])
                    & (100 * n[rows] >= percent * n[some][:, None])
                )
                x, y = some[x], rows[y]
                for cut in range(0, len(x), 1 << 14):
                    u, v = x[cut : cut + (1 << 14)], y[cut : cut + (1 << 14)]
                    close = (coordinates[u] == coordinates[v]).sum(axis=1) >= least
                    close &= (keys[u] == keys[v]).argmax(axis=1) == b[lo]
                    close &= ~(right[v] & (ids[u] < ids[v]))  # both ways round otherwise
                    found.update(zip(ids[u[close]].tolist(), component[v[close]].tolist()))
        x, c = zip(*found) if found else ((), ())
        return pa.table({"visitor": pa.array(x, pa.int64()), "component": pa.array(c, pa.int64())})

    return run


def _across(grouped: DataFrame, joined: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """(visitor, component): texts that are alike in one bucket but not in one component.

    Within a bucket only texts outside its main component are compared with all others;
    a large bucket is dealt to parts of PART_ROWS texts.
    """
    spark = grouped.sparkSession
    placed = grouped.join(joined.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("b", "key", "id", "n", F.coalesce("component", "id").alias("component"))
    counts = placed.groupBy("b", "key", "component").agg(F.count("*").alias("c"))
    buckets = counts.groupBy("b", "key").agg(
        F.sum("c").alias("size"), F.count("*").alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("main")
    )
    rows = placed.join(buckets.where("kinds > 1"), ["b", "key"])
    rows = rows.withColumn("parts", F.ceil(F.col("size") / F.lit(PART_ROWS)).cast("int"))
    rows = rows.withColumns({"home": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "rest": F.col("component") != F.col("main")})
    spread = F.when(F.col("rest"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("part", F.explode(spread)).withColumn("own", F.col("part") == F.col("home"))
    rows = rows.select("b", "key", "part", "id", "n", "component", "own", "rest").join(bands, "id")
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("b", "key", "part"), F.lit(slots)).cast("int"))
    return rows.groupBy("slot").applyInArrow(_alike(percent), "visitor long, component long").distinct()


def _hosted(percent: int):
    """Visitors against all texts of a part of a component, until one is a link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("part", "ascending"), ("guest", "ascending"), ("id", "ascending")])
        component, part = table["component"].to_numpy(), table["part"].to_numpy()
        ids, guest = table["id"].to_numpy(), table["guest"].to_numpy().astype(bool)
        data, offsets = flat_bytes(table["shingles"])
        hashes, bounds = data.view(np.uint64), offsets // 8
        sizes, found = np.diff(bounds), []
        cuts = np.flatnonzero((np.diff(component) != 0) | (np.diff(part) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            hosts = lo + int((~guest[lo:hi]).sum())
            for x in range(hosts, hi):
                own = hashes[bounds[x] : bounds[x + 1]]
                for at in range(lo, hosts, 256):
                    to = min(at + 256, hosts)
                    some = hashes[bounds[at] : bounds[to]]
                    hit = own[np.minimum(np.searchsorted(own, some), len(own) - 1)] == some
                    total = np.concatenate([[0], np.cumsum(hit)])[bounds[at : to + 1] - bounds[at]]
                    shared = np.diff(total)
                    linked = 100 * shared >= percent * (sizes[at:to] + len(own) - shared)
                    if linked.any():
                        found.append((int(ids[x]), int(ids[at + int(linked.argmax())])))
                        break
        u, v = zip(*found) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _visited(visits: DataFrame, joined: DataFrame, docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links between visitors and the components they visit.

    The texts of a component travel once, in parts of SALT_ROWS, whatever the visitors.
    """
    visits = materialize(visits, "visits")
    hosts = visits.select("component").distinct()
    texts = hosts.join(joined, "component").select("component", F.col("node").alias("id"))
    alone = hosts.join(joined.select("component").distinct(), "component", "left_anti")
    texts = texts.unionByName(alone.select("component", F.col("component").alias("id")))
    parts = texts.groupBy("component").agg(F.ceil(F.count("*") / F.lit(SALT_ROWS)).cast("int").alias("parts"))
    texts = texts.join(parts, "component").select(
        "component", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", F.lit(False).alias("guest")
    )
    guests = visits.join(parts, "component").select(
        "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("visitor").alias("id"), F.lit(True).alias("guest")
    )
    roles = texts.unionByName(guests)
    sets = _shingles_of(roles, docs, members)
    slots = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64("component", "part"), F.lit(slots)).cast("int")
    rows = roles.join(sets, "id").select(slot.alias("slot"), "component", "part", "id", "guest", "shingles")
    return materialize(rows.groupBy("slot").applyInArrow(_hosted(percent), "u long, v long"), "links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Per document: n_shingles, component_id (least doc_id reachable), kept, class_id.

    class_id is the least doc_id with exactly the same shingle set.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = source.mapInArrow(_profile, "id long, n long, h1 long, h2 long, bands array<long>")
    order = F.struct("n", "h1", "h2")
    profile = profile.groupBy("id").agg(F.min(order).alias("p"), F.min_by("bands", order).alias("bands"))
    profile = materialize(profile.select("id", "p.*", "bands"), "minhash")
    classes = profile.groupBy("h1", "h2", "n").agg(F.min("id").alias("class_id"))
    members = materialize(
        profile.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"])
        .select("id", "n", "h1", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id")),
        "classes",
    )
    first = members.where("id = class_id and n > 0").select("id")
    bands = profile.where("n > 0").join(first, "id").select("id", "n", F.posexplode("bands").alias("b", "key"))
    shared = bands.groupBy("b", "key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    grouped = materialize(bands.join(shared.select("b", "key", "centre"), ["b", "key"]), "buckets")

    starred = grouped.where("id <> centre").select(F.col("id").alias("member"), "centre").distinct()
    links = _verified(starred, source, members, percent)
    joined = components(links)
    visits = _across(grouped, joined, profile.select("id", "bands"), percent)
    joined = components(links.unionByName(_visited(visits, joined, source, members, percent)))

    named = members.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
    result = named.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    null = F.lit(-(2**63))
    return result.select(
        F.when(F.col("id") != null, F.col("id")).alias(id_col),
        "n_shingles",
        F.when(F.col("component_id") != null, F.col("component_id")).alias("component_id"),
        (F.col("id") == F.col("component_id")).alias("kept"),
        F.when(F.col("class_id") != null, F.col("class_id")).alias("class_id"),
    )
