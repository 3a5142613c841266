"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to ``OWNERS`` owners by document frequency, the rarest to the first. Documents
are cut into shards; a shard's postings (term, document, impact) lie in one column for each
owner. The items of a block travel as a bundle for each shard: it visits the owners in turn, each
visit one cogroup with the owner's postings of that shard, and carries a sparse accumulator
for every (item, document) that may still be among the best. Contributions are integers, so
their order does not matter.

Between visits the tenth best sum of each item so far, over all shards, is a lower bound of
its final tenth score. An accumulator that stays below it even with the most that later owners
can add is dropped, and none is opened where later owners together can't reach it. Both tests
are exact: no document that belongs to the result is lost, equal scores included.

Which terms occur in items travels to the tasks as a bitmap of hashes of fixed size; a false
hit only moves a posting that nobody asks for. Terms are told apart by 64-bit hashes.

Rows: a NULL text or one without terms is no document and matches nothing. Every row is a
document, and every row of ``items`` an item, of its own: rows that repeat an id are ranked
apart. A NULL doc_id sorts first. An item without terms, or that no document matches, returns
nothing; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import flat_bytes, id_array, integers, pieces, split_words
from corpus_spark.session import materialize

TOP = 10
OWNERS = 4
SHARES = (1 / 64, 1 / 8, 1 / 2)  # of all postings, held by the owners before the second, third and last
BITS = 1 << 23  # of a bitmap of terms
SHARD_BYTES = 8 << 20  # text of a shard, or one longer document
BLOCK_ITEMS = 256
BLOCK_TERMS = 32_768  # distinct terms of a block's items, each item's counted

# Fixed by the contract: what separates terms, as bytes of UTF-8.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_POSTING = np.dtype([("term", "<u8"), ("doc", "<i4"), ("impact", "<i4")])
_ENTRY = np.dtype([("item", "<i8"), ("doc", "<i4"), ("sum", "<i8")])


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of all terms and the number of terms of each text."""
    words = split_words(*flat_bytes(column), lower=True, separators=SEPARATORS)
    sizes = np.diff(words.first)
    return words.hash, np.repeat(np.arange(len(sizes)), sizes), sizes


def _counted(term: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, times) of the distinct pairs, sorted by term."""
    order = np.lexsort((text, term))
    term, text = term[order], text[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return term[at], text[at], np.diff(np.append(at, len(term)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) for items (item long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            term, text, _ = _terms(batch.column(1))
            term, text, times = _counted(term, text)
            item = batch.column(0).to_numpy()[text]
            yield pa.record_batch([pa.array(item), pa.array(term.view(np.int64)), pa.array(times)], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term long, times long")


def _bitmaps(terms: DataFrame, owner: Column) -> dict[int, np.ndarray]:
    """For each owner the flags of its terms' hashes; BITS / 8 bytes each come to the driver."""
    place = F.pmod(F.col("term"), F.lit(BITS)) + 1
    rows = (
        terms.select(owner.alias("owner"), F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("owner", "part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out: dict[int, np.ndarray] = {}
    for row in rows:
        width = 8 * len(row["bits"])
        flags = out.setdefault(row["owner"], np.zeros(BITS, bool))
        flags[(row["part"] - 1) * width : row["part"] * width] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
    return {owner: np.packbits(flags) for owner, flags in out.items()}


def _hits(bitmap: np.ndarray, term: np.ndarray) -> np.ndarray:
    place = term & np.uint64(BITS - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _statistics(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, df, most, least): documents, highest frequency and shortest document of each wanted term.

    A row with a NULL term has the number of documents and, as ``most``, of all terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, SHARD_BYTES):
            term, text, sizes = _terms(batch.column(1))
            total = (int((sizes > 0).sum()), int(sizes.sum()))
            some = _hits(wanted, term)
            term, text, times = _counted(term[some], text[some])
            at = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            df = np.diff(np.append(at, len(term)))
            most = np.maximum.reduceat(times, at) if len(at) else at
            least = np.minimum.reduceat(sizes[text], at) if len(at) else at
            keys = pa.array(np.append(term[at].view(np.int64), 0), mask=np.append(np.zeros(len(at), bool), True))
            columns = [keys, *(pa.array(np.append(x, y).astype(np.int64)) for x, y in ((df, total[0]), (most, 0), (least, 0)))]
            terms = pa.array(np.append(np.zeros(len(at), np.int64), total[1]))
            yield pa.record_batch([*columns, terms], ["term", "df", "most", "least", "terms"])

    found = docs.select("id", "text").mapInArrow(run, "term long, df long, most long, least long, terms long")
    return found.groupBy("term").agg(
        F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"), F.sum("terms").alias("terms")
    )


def _norm(sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 75 + (75 * n * N) div L, exact where the product leaves 64 bits."""
    if len(sizes) and 75 * int(sizes.max()) * documents >= 2**63:
        return np.array([25 + 75 * int(n) * documents // terms for n in sizes], np.int64)
    return 25 + 75 * sizes.astype(np.int64) * documents // terms


def _shards(docs: DataFrame, bitmaps: dict[int, np.ndarray], documents: int, terms: int) -> DataFrame:
    """(shard, ids, p0 .. ): the ids of a shard's documents and each owner's postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(pieces(batches, 1, SHARD_BYTES)):
            term, text, sizes = _terms(batch.column(1))
            norm = _norm(sizes, documents, terms)
            columns = [pa.array([first + number]), pa.array([integers(batch.column(0)).tobytes()], pa.binary())]
            for owner in range(OWNERS):
                some = _hits(bitmaps[owner], term) if owner in bitmaps else np.zeros(len(term), bool)
                t, d, times = _counted(term[some], text[some])
                rows = np.empty(len(t), _POSTING)
                rows["term"], rows["doc"] = t, d
                rows["impact"] = 1_000_000_000 * times // (1000 * times + 8 * norm[d])
                columns.append(pa.array([rows.tobytes()], pa.binary()))
            yield pa.record_batch(columns, ["shard", "ids", *(f"p{o}" for o in range(OWNERS))])

    parts = ", ".join(f"p{o} binary" for o in range(OWNERS))
    return materialize(docs.select("id", "text").mapInArrow(run, f"shard long, ids binary, {parts}"), "search-shards")


def _owners(terms: DataFrame) -> Column:
    """The owner of a term, from its document frequency's power of two (at most 64 counts)."""
    octave = F.floor(F.log2(F.col("df").cast("double"))).cast("int")
    sizes = dict(tuple(r) for r in terms.groupBy(octave.alias("octave")).agg(F.sum("df")).collect())
    total, so_far, owner, cases = sum(sizes.values()), 0, 0, F.lit(OWNERS - 1)
    bounds = []
    for number in sorted(sizes):
        so_far += sizes[number]
        while owner < len(SHARES) and so_far > SHARES[owner] * total:
            owner += 1
            bounds.append(number)
    for i, bound in reversed(list(enumerate(bounds))):
        cases = F.when(octave < bound, F.lit(i)).otherwise(cases)
    return cases


def _best(sums: np.ndarray, top: int) -> np.ndarray:
    """The top-th largest of each row, 0 where there are fewer."""
    if sums.shape[1] < top:
        return np.zeros(len(sums), np.int64)
    return np.partition(sums, sums.shape[1] - top, axis=1)[:, sums.shape[1] - top]


def _list(column: pa.ChunkedArray, field: str) -> np.ndarray:
    values = column.combine_chunks().flatten()
    return values.field(field).to_numpy(zero_copy_only=False)


def _visit(owner: int, top: int) -> Callable:
    """One bundle at one owner: add its contributions, drop what can no longer win."""
    last = owner == OWNERS - 1

    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundle.num_rows or not postings.num_rows:
            return _OUT.empty_table()
        ids = np.frombuffer(postings["ids"][0].as_py(), np.int64)
        rows = np.frombuffer(postings["postings"][0].as_py(), _POSTING)
        items = _list(bundle["bounds"], "item")
        order = np.argsort(items)
        items = items[order]
        now, later, least = (_list(bundle["bounds"], f)[order] for f in ("now", "later", "least"))
        sums = np.zeros((len(items), len(ids)), np.int64)
        carried = np.frombuffer(bundle["carried"][0].as_py(), _ENTRY)
        sums[np.searchsorted(items, carried["item"]), carried["doc"]] = carried["sum"]
        opened = (sums > 0) | (now + later >= least)[:, None]
        who, term, weight = (_list(bundle["terms"], f) for f in ("item", "term", "weight"))
        term = term.view(np.uint64)
        order = np.argsort(term, kind="stable")
        who, term, weight = np.searchsorted(items, who[order]), term[order], weight[order]
        _, at = np.unique(term, return_index=True)
        lo, hi = np.searchsorted(rows["term"], term[at], "left"), np.searchsorted(rows["term"], term[at], "right")
        for a, b, x, y in zip(at.tolist(), _ends(term, at), lo.tolist(), hi.tolist()):
            if y > x:
                sums[np.ix_(who[a:b], rows["doc"][x:y])] += weight[a:b, None] * rows["impact"][x:y].astype(np.int64)
        sums[~opened] = 0
        least = np.maximum(least, _best(sums, top))
        keep = (sums > 0) & (sums + later[:, None] >= least[:, None])
        item, doc = np.nonzero(keep)
        value = sums[item, doc]
        if not last:
            entries = np.empty(len(item), _ENTRY)
            entries["item"], entries["doc"], entries["sum"] = items[item], doc, value
        # The best of this shard, nearest the top first; equal sums by id.
        order = np.lexsort((ids[doc], -value, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order], "left")
        order = order[rank < top]
        best = pa.StructArray.from_arrays(
            [pa.array(items[item[order]]), id_array(ids[doc[order]]), pa.array(value[order])], ["item", "doc_id", "sum"]
        )
        return pa.table(
            {
                "block": bundle["block"],
                "shard": bundle["shard"],
                "carried": pa.array([b"" if last else entries.tobytes()], pa.binary()),
                "best": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), best),
            }
        )

    return run


def _ends(values: np.ndarray, at: np.ndarray) -> list[int]:
    return np.append(at[1:], len(values)).tolist() if len(at) else []


_BEST = "array<struct<item: long, doc_id: long, sum: long>>"
_OUT = pa.schema(
    [
        ("block", pa.int32()), ("shard", pa.int64()), ("carried", pa.binary()),
        ("best", pa.list_(pa.struct([("item", pa.int64()), ("doc_id", pa.int64()), ("sum", pa.int64())]))),
    ]
)


def _ranked(visited: DataFrame, top: int) -> DataFrame:
    """(item, doc_id, sum, rank): the best of all shards."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum"), "doc_id"))
    return visited.select(F.explode("best").alias("b")).select("b.*").withColumn("rank", rank).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "search-items")
    asked = materialize(item_terms(items), "search-item-terms")
    kind = items.schema["item_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    wanted = _bitmaps(asked, F.lit(0))
    if not wanted:
        return nothing
    stats = materialize(_statistics(docs, wanted[0]), "search-terms")
    found = stats.where("term is null").first()
    documents, terms = (found["df"], found["terms"]) if found else (0, 0)
    if not terms:
        return nothing

    known = stats.where("term is not null")
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    norm = F.lit(25) + F.expr(f"cast(75 * cast(least as decimal(20)) * {documents} div {terms} as bigint)")
    impact = F.expr("1000000000 * most div (1000 * most + 8 * norm)")
    known = known.select("term", "df", weight.alias("w"), "most", norm.alias("norm")).withColumn("top", F.col("w") * impact)
    known = known.join(asked.select("term").distinct(), "term", "left_semi")
    known = known.withColumn("owner", _owners(known)).select("term", "owner", "w", "top")
    known = materialize(known, "search-owners")
    shards = _shards(docs, _bitmaps(known, F.col("owner")), documents, terms)

    size = asked.agg(F.countDistinct("item"), F.count("*")).first()
    blocks = max(-(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asked = materialize(
        asked.join(known, "term").select(block.alias("block"), "item", "term", "owner", (F.col("w") * F.col("times")).alias("weight"), (F.col("top") * F.col("times")).alias("most")),
        "search-asked",
    )
    least = asked.groupBy("item").agg(F.lit(0).cast("bigint").alias("least"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    bundles = shards.select(every.alias("block"), "shard", F.lit(b"").alias("carried"))
    for owner in range(OWNERS):
        now = F.sum(F.when(F.col("owner") == owner, F.col("most")).otherwise(0)).alias("now")
        later = F.sum(F.when(F.col("owner") > owner, F.col("most")).otherwise(0)).alias("later")
        bounds = asked.groupBy("block", "item").agg(now, later).join(least, "item", "left").na.fill(0, ["least"])
        bounds = bounds.groupBy("block").agg(F.collect_list(F.struct("item", "now", "later", "least")).alias("bounds"))
        mine = asked.where(F.col("owner") == owner).groupBy("block")
        mine = mine.agg(F.collect_list(F.struct("item", "term", "weight")).alias("terms"))
        none = F.array().cast("array<struct<item: long, term: long, weight: long>>")
        bundle = bundles.join(bounds, "block").join(mine, "block", "left").withColumn("terms", F.coalesce("terms", none))
        postings = shards.select(every.alias("of"), F.col("shard").alias("at"), "ids", F.col(f"p{owner}").alias("postings"))
        visited = bundle.groupBy("block", "shard").cogroup(postings.groupBy("of", "at"))
        visited = visited.applyInArrow(_visit(owner, top), f"block int, shard long, carried binary, best {_BEST}")
        visited = materialize(visited, f"search-visit-{owner}")
        bundles = visited.select("block", "shard", "carried")
        least = _ranked(visited, top).where(F.col("rank") == top).select("item", F.col("sum").alias("least"))
    best = _ranked(visited, top).join(items.select("item", "item_id"), "item")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("sum").alias("score"))


def search_sql(top: int = TOP) -> str:
    """The same for the tables ``documents`` and ``benchmark``, whose ids are unique."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({cut}) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({cut}) AS term FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
t AS (SELECT count(*) AS docs, sum(n) AS terms FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
m AS (SELECT doc_id, 25 + (75 * n::HUGEINT * docs) // terms AS m FROM n, t),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""
