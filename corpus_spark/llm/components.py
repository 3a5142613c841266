"""Connected components of a table of links, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.skew import salted_join
from corpus_spark.session import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included."""
    return edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every link with its node's least neighbour; a hub's links are dealt to several tasks."""
    return salted_join(edges, least, ["u"], F.xxhash64("v"), salts=8)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for links (u, v): the component is the least node reachable.

    Alternates two steps until nothing moves: every node hands its larger neighbours to
    its least neighbour, then its smaller ones. Each round writes its links; the
    number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").distinct(), "links")
    while True:
        both = _both(edges)
        large = _with_least(both, _least(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "links")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(down, _least(down)).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        after = materialize(small.select("e.*").where("u <> v").distinct(), "links")
        if _same(edges, after):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def _same(a: DataFrame, b: DataFrame) -> bool:
    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64(F.least("u", "v"), F.greatest("u", "v"))
        return df.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()

    return tuple(mark(a)) == tuple(mark(b))
