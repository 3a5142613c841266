"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm.attention_lm import lm_scores
from corpus_spark.llm.decontaminate import contaminated_passages
from corpus_spark.llm.hard_negatives import hard_negatives, hard_negatives_sql, integer_rows, shifted_labels
from corpus_spark.llm.hilbert import nearest_neighbours
from corpus_spark.llm.minhash import near_duplicates
from corpus_spark.llm.mixing import mix_sources, mix_sql
from corpus_spark.llm.ranked_search import search, search_sql
from corpus_spark.llm.simhash import simhash_groups
from corpus_spark.llm.substring import substring_report
from corpus_spark.llm.suffix_array import suffix_array_report
from corpus_spark.llm.tool_calls import TURN_SCHEMAS, link_tool_calls, tool_call_sql, turns_as_calls
from corpus_spark.llm.toxicity import FOLDS, crc_fold, learn_toxicity, score_toxicity
from corpus_spark.llm.url_filter import HOST_RULES, PATTERN_RULES, filter_sql, filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_report(_table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(_table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_toxicity(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        (crc_fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


ORACLES["op3_mixing"] = mix_sql()


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), HOST_RULES, PATTERN_RULES)


@query
def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(_table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, TURN_SCHEMAS)


ORACLES["op6_url_filter"] = filter_sql()
ORACLES["op7_tool_call_linking"] = tool_call_sql()


@query
def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


@query
def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(shifted_labels(integer_rows(_table(spark, sf_dir, "embeddings"))))


ORACLES["op11_hard_negatives"] = hard_negatives_sql()


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op13_ranked_search"] = search_sql()
