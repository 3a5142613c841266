"""Registration, table access and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.constants import SEPARATORS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The documents hold none of the usual separators, so a line break joins them.
DOC_SEPARATORS = (*SEPARATORS, "\n")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows: (rid, conv_id, turn, question, reply).

    The join key holds conversation and turn, so one long conversation spreads
    over all partitions.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(replies, ["conv_id", "turn"]).withColumn(
        "rid", F.concat_ws(":", "conv_id", "turn")
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def rounded(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# --- SQL building blocks ---------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '\\s+'), lambda x: x <> '')"


PAIRS_SQL = """
pairs AS (
  SELECT q.conv_id, q.turn, q.text AS question, r.text AS reply,
         q.conv_id || ':' || q.turn AS rid
  FROM conversations q JOIN conversations r
    ON r.conv_id = q.conv_id AND r.turn = q.turn + 1
  WHERE q.role = 'user' AND r.role = 'assistant')"""

LABELLED_SQL = """
labelled AS (
  SELECT d.doc_id, d.text, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l USING (doc_id))"""


def sql_shuffle(seed: int, *keys: str) -> str:
    return f"md5('{seed}:' || " + " || ':' || ".join(keys) + ")"


def sql_split(name: str, source: str, keys: tuple[str, ...] = ("doc_id",), seed: int = 5) -> str:
    """A CTE that adds the exact 80/10/10 split to a source."""
    order = ", ".join([sql_shuffle(seed, *keys), *keys])
    return f"""
{name} AS (
  SELECT * EXCLUDE (rn_, n_),
    CASE WHEN rn_ <= n_ - ceil(0.2::DOUBLE * n_) THEN 'train'
         WHEN rn_ <= n_ - ceil(0.5::DOUBLE * ceil(0.2::DOUBLE * n_)) THEN 'validation'
         ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn_, count(*) OVER () AS n_
        FROM {source}))"""


def sql_repack(name: str, source: str, key: str, text: str, max_length: int, separators: tuple[str, ...]) -> str:
    """CTEs for segment repacking: the joined prefix of segments that fits."""
    cases = " ".join(f"WHEN contains({text}, {lit(s)}) THEN {lit(s)}" for s in separators)
    return f"""
{name}_sep AS (SELECT *, CASE {cases} END AS sep_ FROM {source}),
{name}_seg AS (
  SELECT {key} AS k_, unnest(string_split({text}, sep_)) AS s_,
         generate_subscripts(string_split({text}, sep_), 1) AS p_
  FROM {name}_sep WHERE sep_ IS NOT NULL),
{name}_cum AS (
  SELECT *, sum(length(s_) + 1) OVER (PARTITION BY k_ ORDER BY p_) - 1 AS c_
  FROM {name}_seg WHERE length(s_) <= {max_length}),
{name}_join AS (
  SELECT k_, string_agg(s_, chr(10) ORDER BY p_) AS t_
  FROM {name}_cum WHERE c_ <= {max_length} GROUP BY k_),
{name} AS (
  SELECT s.* EXCLUDE (sep_, {text}), CASE WHEN sep_ IS NULL THEN s.{text} ELSE t_ END AS {text}
  FROM {name}_sep s LEFT JOIN {name}_join ON k_ = s.{key}
  WHERE CASE WHEN sep_ IS NULL THEN length(s.{text}) <= {max_length} ELSE t_ IS NOT NULL END)"""


def sql_vocab(texts: str, size: int | None = None, specials: bool = False) -> str:
    """A CTE with the learnt vocabulary of a query that yields ``text``."""
    text = "replace(text, '</s>', ' </s> ')" if specials else "text"
    cut = f"WHERE id < {size}" if size is not None else ""
    return f"""
voc AS (
  SELECT * FROM (
    SELECT token, 1 + row_number() OVER (ORDER BY count(*) DESC, token) AS id, count(*) AS n
    FROM (SELECT unnest({sql_words(text)}) AS token FROM ({texts}))
    WHERE token NOT IN ('[PAD]', '</s>') GROUP BY token) {cut}
  UNION ALL SELECT '[PAD]', 0, 0 UNION ALL SELECT '</s>', 1, 0)"""


def sql_encode(
    name: str, source: str, key: str, text: str, out: str,
    max_len: int | None = None, specials: bool = False,
) -> str:
    """A CTE that adds the id list of a text to a source."""
    toks = sql_words(f"replace({text}, '</s>', ' </s> ')" if specials else text)
    ids = "coalesce(e_.ids_, []::BIGINT[])"
    if max_len is not None:
        ids = f"list_slice({ids}, 1, {max_len})"
    return f"""
{name} AS (
  SELECT s_.*, {ids} AS {out}
  FROM {source} s_ LEFT JOIN (
    SELECT k_, list(coalesce(v_.id, 1) ORDER BY p_) AS ids_
    FROM (SELECT {key} AS k_, unnest({toks}) AS token, generate_subscripts({toks}, 1) AS p_
          FROM {source}) t_
    LEFT JOIN voc v_ USING (token) GROUP BY k_) e_ ON e_.k_ = s_.{key})"""


def sql_join(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def sql_pad(ids: str, length: str | int, fill: int) -> str:
    return (
        f"list_concat({ids}, list_transform(range(greatest({length} - len({ids}), 0)), "
        f"lambda i_: {fill}::BIGINT))"
    )


def sql_mask(ids: str) -> str:
    return f"list_transform({ids}, lambda m_: CASE WHEN m_ <> 0 THEN 1 ELSE 0 END)"


def sql_template(template: str, **slots: str) -> str:
    """Concatenation of the literal parts of a template and SQL expressions."""
    import string

    parts = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if slot is not None:
            parts.append(slots[slot])
    return " || ".join(parts)
