"""Joins whose left side may hold one key in a third of its rows, or whose right side names few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined to right, which has one row for each key, with every key in ``salts`` parts.

    ``salt`` is any long of a left row; only how even the parts are depends on it. The
    narrow right side is repeated ``salts`` times.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    dealt = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    return dealt.join(right.withColumn("_salt", every), [*keys, "_salt"], how).drop("_salt")


WORDS = 1 << 15


def may_hold(df: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be among the keys, rows where it is surely not).

    The keys become a bitmap of their hashes with WORDS * 64 bits (256 kB), whatever their
    number, which every task probes inside the projection; wide rows that no join needs are not moved. NULL is no key.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(WORDS * 64))
    placed = keys.where(F.col(key).isNotNull()).select(place.alias("place"))
    placed = placed.selectExpr("cast(place div 64 as int) as word", "shiftleft(1L, cast(place % 64 as int)) as flag")
    words = [0] * WORDS
    for word, flags in placed.groupBy("word").agg(F.bit_or("flag")).collect():  # at most WORDS rows
        words[word] = flags
    table = df.sparkSession.createDataFrame([(words,)], "words array<long>").scalar()
    probe = F.pmod(F.xxhash64(F.col(column)), F.lit(WORDS * 64))
    marked = df.withColumns({"_words": table, "_place": probe})
    hit = F.expr("shiftrightunsigned(get(_words, cast(_place div 64 as int)), cast(_place % 64 as int)) & 1L = 1L")
    marked = marked.withColumn("_hit", F.col(column).isNotNull() & hit).drop("_words", "_place")
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")
