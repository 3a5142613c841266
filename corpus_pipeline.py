"""The training-data pipeline: documents in, a mixed training set out.

Each stage gets what its predecessor kept, written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm.decontaminate import drop_contaminated
from corpus_spark.llm.minhash import near_duplicates
from corpus_spark.llm.mixing import mix_sources
from corpus_spark.llm.skew import may_hold
from corpus_spark.llm.suffix_array import suffix_array_dedup
from corpus_spark.llm.toxicity import learn_toxicity, score_toxicity
from corpus_spark.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go."""
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, out="toxicity_").where("toxicity_ < 0.5").drop("toxicity_")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays, once.

    Documents without a doc_id cannot be told apart and all stay.
    """
    found = materialize(near_duplicates(docs.where("doc_id is not null")).select("doc_id", "kept"), "near-duplicates")
    copies = found.where("not kept").select("doc_id")
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Only rows that may be copies or repeated are moved.
    doubtful, clear = may_hold(docs, "doc_id", copies.unionByName(repeated), "doc_id")
    doubtful = doubtful.join(copies, "doc_id", "left_anti").dropDuplicates(docs.columns)
    return clear.unionByName(doubtful.select(docs.columns))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that start earlier are cut out; every document stays, n_chars follows."""
    cut = suffix_array_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, text included, for each time a document is taken into the training set."""
    return mix_sources(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source")])


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
# A trained classifier and alignments have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
