"""Mix sources by temperature: weights, budgets and block permutations, all in Spark SQL.

*Weights.* A source with the share p of all words gets a weight in proportion to p**a.
Smaller exponents are fairer and repeat small sources more often. The exponent is
bisected: the largest that reaches the target entropy (a part of the logarithm of the
number of sources), but not below the smallest at which no source is repeated more
often than ``max_epochs``. STEPS halvings, five at a time, each a one-row aggregate over
the table of sources.

*Realisation.* The budget is a multiple of all words. A source's documents are dealt to
blocks by hash, about BLOCK_DOCS to a block but at most MAX_BLOCKS blocks, and every
epoch takes the blocks in a permutation of its own until the source's budget is spent.
Whole epochs and whole blocks come first; of the last block documents are taken in the
epoch's order while they fit. No window is larger than a source's table of blocks or a
single block, so a source that holds most rows is spread like any other.

Rows: the result has one row for each time a document is taken. Documents without
words, NULL texts included, weigh nothing and are taken with every epoch of their block.
A source without words gets weight 0. NULL is a source like any other; NULL ids are
ordered before all others. Repeated rows are taken as often as they are there. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.session import materialize

ENTROPY = 0.95
MAX_EPOCHS = 4.0
BUDGET = 1.0
BLOCK_DOCS = 64
MAX_BLOCKS = 16_384
STEPS, AT_ONCE = 40, 5
SEED = 17


def _draw(*parts: str | Column) -> Column:
    """A uniform whole number below 2**32 from the first 8 hexadecimal digits of an md5."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in map(_column, parts)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _exponent(sizes: DataFrame, entropy: float, max_epochs: float, budget: float) -> float:
    """The temperature exponent; ``sizes`` holds one row (words) per source."""
    known = sizes.where("words > 0").agg(F.count("*"), F.sum("words"), F.min("words")).first()
    sources, total, least = known[0], known[1], known[2]
    if sources < 2:
        return 1.0
    p = F.col("words") / F.lit(float(total))

    def search(test) -> float:
        """The largest dyadic a in [0, 1) with test(a), for a test that holds below some point."""
        low, width = 0.0, 1.0
        for _ in range(STEPS // AT_ONCE):
            width /= 2**AT_ONCE
            at = [low + width * i for i in range(1, 2**AT_ONCE)]
            sums = [F.sum(F.pow(p, F.lit(a))) for a in at] + [F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in at]
            row = sizes.where("words > 0").agg(*sums).first()
            held = sum(bool(test(a, row[i], row[len(at) + i])) for i, a in enumerate(at))
            low += width * held
        return low

    fair = search(lambda a, z, zl: math.log(z) - a * zl / z >= entropy * math.log(sources))
    often = search(lambda a, z, _: (least / total) ** (a - 1) * budget / z > max_epochs)
    return max(fair, often)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET, carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, n_words, weight, epoch, block_start, carried columns): which documents an epoch takes.

    ``block_start`` counts the source's words before the document's block, over all epochs:
    sorting by its share of the source's budget interleaves the sources.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    carried = {f"c{i}": c for i, c in enumerate(carry)}
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), words.alias("n_words"), *[F.col(c).alias(k) for k, c in carried.items()])
    rows = materialize(rows, "mixing-words")
    sizes = materialize(rows.groupBy("name").agg(F.sum("n_words").alias("words"), F.count("*").alias("docs")), "sources")
    total = sizes.agg(F.sum("words")).first()[0] or 0
    a = _exponent(sizes, entropy, max_epochs, budget)
    power = F.when(F.col("words") > 0, F.pow(F.col("words") / F.lit(float(total or 1)), F.lit(a))).otherwise(F.lit(0.0))
    scale = sizes.agg(F.sum(power)).first()[0] or 1.0
    quota = F.floor(F.col("weight") * F.lit(float(total) * budget)).cast("bigint")
    blocks = F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MAX_BLOCKS)).cast("bigint")
    plan = sizes.withColumn("weight", power / F.lit(float(scale))).withColumns({"quota": quota, "blocks": blocks})
    whole = F.when(F.col("words") > 0, F.floor(F.col("quota") / F.greatest("words", F.lit(1)))).otherwise(F.lit(-1))
    plan = plan.withColumn("whole", whole.cast("bigint"))
    plan = materialize(plan.withColumn("rest", F.col("quota") - F.col("whole") * F.col("words")), "mixing-plan")

    placed = rows.join(plan.select("name", "blocks"), "name").withColumn("block", F.pmod(_draw("id"), F.col("blocks")))
    placed = placed.drop("blocks")
    epochs = plan.where("whole >= 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))))
    each = placed.groupBy("name", "block").agg(F.sum("n_words").alias("block_words"))
    each = each.join(epochs.select("name", "epoch", "whole", "rest", "words", "weight"), "name")
    order = Window.partitionBy("name", "epoch").orderBy(_draw("name", "epoch", "block"), "block")
    before = F.sum("block_words").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("before", F.coalesce(before, F.lit(0)))
    room = F.when(F.col("epoch") < F.col("whole"), F.col("block_words")).otherwise(
        F.least(F.col("block_words"), F.col("rest") - F.col("before"))
    )
    taken = each.withColumn("room", room).where("room > 0 or (room = 0 and epoch < whole)")
    taken = taken.select(
        "name", "block", "epoch", "weight", "room", (F.col("room") < F.col("block_words")).alias("cut"),
        (F.col("before") + F.col("epoch") * F.col("words")).alias("block_start"),
    )
    joined = placed.join(taken, ["name", "block"])
    full = joined.where("not cut")
    inner = Window.partitionBy("name", "block", "epoch").orderBy(_draw("epoch", "id"), "id", "n_words")
    partly = joined.where("cut").withColumn("upto", F.sum("n_words").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    columns = [
        F.col("id").alias(id_col),
        F.when(F.col("name") != "", F.substring(F.col("name"), 2, 2**31 - 1)).alias(source_col),
        "n_words", F.round("weight", 9).alias("weight"), "epoch", "block_start",
        *[F.col(k).alias(c) for k, c in carried.items()],
    ]
    return full.select(*columns).unionByName(partly.where("upto <= room").select(*columns))


def mix_sql(
    docs: str = "documents", entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float = BUDGET
) -> str:
    """The same result as SQL."""

    def draw(*parts: str) -> str:
        text = " || ':' || ".join([f"'{SEED}'", *[f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts]])
        return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"

    return f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id AS id, coalesce('=' || source, '') AS name,
         coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS n_words
  FROM {docs}),
sizes AS (SELECT name, sum(n_words)::BIGINT AS words, count(*) AS docs FROM rows_ GROUP BY name),
p AS (SELECT words / (SELECT sum(words) FROM sizes)::DOUBLE AS p FROM sizes WHERE words > 0),
fair AS (
  SELECT 0 AS i, 0::DOUBLE AS low
  UNION ALL
  SELECT i + 1, low + CASE WHEN (
    SELECT ln(sum(pow(p, low + pow(0.5, i + 1)))) - (low + pow(0.5, i + 1)) * sum(pow(p, low + pow(0.5, i + 1)) * ln(p))
           / sum(pow(p, low + pow(0.5, i + 1))) >= {entropy} * ln(count(*)) FROM p) THEN pow(0.5, i + 1) ELSE 0 END
  FROM fair WHERE i < {STEPS}),
often AS (
  SELECT 0 AS i, 0::DOUBLE AS low
  UNION ALL
  SELECT i + 1, low + CASE WHEN (
    SELECT pow(min(p), low + pow(0.5, i + 1) - 1) * {budget} / sum(pow(p, low + pow(0.5, i + 1))) > {max_epochs} FROM p)
    THEN pow(0.5, i + 1) ELSE 0 END
  FROM often WHERE i < {STEPS}),
a AS (
  SELECT CASE WHEN (SELECT count(*) FROM p) < 2 THEN 1 ELSE greatest(
    (SELECT max(low) FROM fair), (SELECT max(low) FROM often)) END AS a),
powers AS (
  SELECT name, words, docs, (SELECT sum(words) FROM sizes)::DOUBLE AS total,
         CASE WHEN words > 0 THEN pow(words / (SELECT sum(words) FROM sizes)::DOUBLE, (SELECT a FROM a)) ELSE 0 END AS w
  FROM sizes),
weights AS (SELECT *, w / (SELECT sum(w) FROM powers) AS weight FROM powers),
quotas AS (
  SELECT *, floor(weight * (total * {budget}))::BIGINT AS quota,
         least(ceil(docs / {BLOCK_DOCS}.0), {MAX_BLOCKS})::BIGINT AS blocks
  FROM weights WHERE words > 0),
plan AS (SELECT *, quota // words AS whole, quota - (quota // words) * words AS rest FROM quotas),
placed AS (
  SELECT r.id, r.name, r.n_words, {draw("r.id")} % q.blocks AS block FROM rows_ r JOIN plan q USING (name)),
each_ AS (
  SELECT b.*, q.whole, q.rest, q.words, q.weight, e.epoch,
    coalesce(sum(block_words) OVER (PARTITION BY b.name, e.epoch ORDER BY {draw("b.name", "e.epoch", "b.block")}, b.block
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT name, block, sum(n_words) AS block_words FROM placed GROUP BY ALL) b
  JOIN plan q USING (name), LATERAL (SELECT unnest(range(0, q.whole + 1)) AS epoch) e),
taken AS (
  SELECT *, CASE WHEN epoch < whole THEN block_words ELSE least(block_words, rest - before) END AS room FROM each_),
upto AS (
  SELECT p.id, p.name, p.n_words, t.weight, t.epoch, t.before + t.epoch * t.words AS block_start, t.room, t.block_words,
    sum(p.n_words) OVER (PARTITION BY p.name, p.block, t.epoch ORDER BY {draw("t.epoch", "p.id")}, p.id, p.n_words
      ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p JOIN taken t ON p.name = t.name AND p.block = t.block
  WHERE t.room > 0 OR (t.room = 0 AND t.epoch < t.whole))
SELECT id AS doc_id, CASE WHEN name <> '' THEN substr(name, 2) END AS source, n_words, round(weight, 9) AS weight,
       epoch::BIGINT AS epoch, block_start::BIGINT AS block_start
FROM upto WHERE room >= block_words OR upto <= room"""
