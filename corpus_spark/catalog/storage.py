"""Queries: readers and writers, each on data written from the given tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from corpus_spark.catalog.cleaning import PROMPT_SQL
from corpus_spark.catalog.registry import (
    DOC_SEPARATORS,
    LABELLED_SQL,
    query,
    rounded,
    sql_split,
    table,
)
from corpus_spark.functions import text_size
from corpus_spark.operators.metrics import row_counts, weighted_scores
from corpus_spark.operators.order import split_exact
from corpus_spark.plans.clean import CleanConfig, run_task
from corpus_spark.session import scratch_path
from corpus_spark.sources import (
    cached_or,
    copy_dataset,
    preview,
    cached_files,
    publish,
    read_any,
    read_csv,
    read_named,
    read_splits,
    read_text,
    speed_metrics,
    write_csv,
    write_metrics,
    write_splits,
)


def _split_documents(spark, sf_dir):
    return split_exact(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("SELECT doc_id::VARCHAR AS id, text FROM documents")
def csv_forced_columns(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), path)
    return read_csv(spark, path, columns=["id", "text"], multi_line=True)


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def csv_header_columns(spark, sf_dir):
    root = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "conversations"), f"{root}/turns.csv")
    return read_any(spark, "turns.csv", root, multi_line=True)


@query("SELECT doc_id, lang, text FROM documents")
def json_source(spark, sf_dir):
    root = scratch_path(spark, "json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs.write.json(f"{root}/documents.json")
    return read_any(spark, "documents.json", root, schema=docs.schema)


@query(
    "SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY text"
)
def text_lines(spark, sf_dir):
    """One row per line of a plain-text corpus, kept as a written table."""
    root = scratch_path(spark, "lines")
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    lines.write.text(f"{root}/raw")
    rows = cached_or(spark, f"{root}/cached", lambda: read_text(spark, f"{root}/raw"))
    return rows.groupBy("text").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS text FROM documents)
    SELECT text, false AS fresh, count(*) AS n FROM l GROUP BY text
    UNION ALL SELECT text, true, count(*) FROM l WHERE lang = 'fr' GROUP BY text"""
)
def cached_text_files(spark, sf_dir):
    """Lines of a folder of text files, read again after files were added: only those are fresh."""
    root = scratch_path(spark, "files")
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("value"))

    def read():
        return cached_files(spark, f"{root}/raw", f"{root}/cache", lambda lines: lines.where("text is not null"))

    docs.select("value").write.text(f"{root}/raw/first")
    known = [r[0] for r in read().select("batch").distinct().collect()]
    docs.where("lang = 'fr'").select("value").write.text(f"{root}/raw/second")
    rows = read().select("text", (~F.col("batch").isin(known)).alias("fresh"))
    return rows.groupBy("text", "fresh").agg(F.count("*").alias("n"))


@query(f"WITH {sql_split('s', 'documents')} SELECT doc_id, text FROM s WHERE split = 'validation'")
def named_dataset(spark, sf_dir):
    root = scratch_path(spark, "named")
    publish(_split_documents(spark, sf_dir), root, "corpus", "first")
    return read_named(spark, root, "corpus", split="validation", revision="first")


@query(f"WITH {sql_split('s', 'documents')} SELECT doc_id, text, split FROM s")
def saved_splits(spark, sf_dir):
    path = write_splits(_split_documents(spark, sf_dir), scratch_path(spark, "splits"))
    return read_splits(spark, path)


@query(f"WITH {sql_split('s', 'documents')} SELECT split, count(*) AS n FROM s GROUP BY split")
def split_sizes(spark, sf_dir):
    """Rows per split of a saved dataset after a copy to another location."""
    path = write_splits(_split_documents(spark, sf_dir), scratch_path(spark, "splits"))
    copied = copy_dataset(spark, path, scratch_path(spark, "copy"))
    return row_counts(read_splits(spark, copied))


@query(
    f"""WITH {LABELLED_SQL},
    cls AS (SELECT c AS cls FROM (SELECT quality AS c FROM labelled UNION SELECT toxic FROM labelled)),
    per AS (SELECT cls, (SELECT count(*) FROM labelled WHERE quality = cls) AS support,
      (SELECT count(*) FROM labelled WHERE toxic = cls) AS predicted,
      (SELECT count(*) FROM labelled WHERE quality = cls AND toxic = cls) AS hits FROM cls),
    sc AS (SELECT support, hits, CASE WHEN predicted = 0 THEN 0.0 ELSE hits::DOUBLE / predicted END AS p,
      CASE WHEN support = 0 THEN 0.0 ELSE hits::DOUBLE / support END AS r FROM per),
    m AS (SELECT sum(hits)::DOUBLE / sum(support) AS accuracy, sum(p * support) / sum(support) AS "precision",
      sum(r * support) / sum(support) AS recall,
      sum(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END * support) / sum(support) AS f1 FROM sc)
    SELECT 'first' AS run, 'eval' AS split, metric, round(value, 6) AS value
    FROM (UNPIVOT m ON accuracy, "precision", recall, f1 INTO NAME metric VALUE value)"""
)
def metrics_log(spark, sf_dir):
    """Metric rows appended to a log and read back."""
    path = scratch_path(spark, "metrics")
    scores = weighted_scores(table(spark, sf_dir, "labels"), "quality", "toxic")
    write_metrics(scores, path, "first", "eval")
    log = spark.read.schema("run string, split string, metric string, value double").json(path)
    return log.withColumn("value", rounded("value"))


@query(
    """WITH n AS (SELECT count(*)::DOUBLE AS samples FROM documents)
    SELECT 'encode' AS run, 'train' AS split, metric, value FROM (
      SELECT 'samples' AS metric, samples AS value FROM n
      UNION ALL SELECT 'runtime', 1 UNION ALL SELECT 'samples_per_second', 1)"""
)
def run_summary(spark, sf_dir):
    """Rows and time of a job over all texts, logged and read back; of times only the sign is kept."""
    path = scratch_path(spark, "speed")
    start = time.perf_counter()
    done = table(spark, sf_dir, "documents").agg(F.count("*"), F.sum(text_size(F.col("text")))).first()
    write_metrics(speed_metrics(spark, done[0], time.perf_counter() - start), path, "encode", "train")
    log = spark.read.schema("run string, split string, metric string, value double").json(path)
    return log.withColumn("value", F.when(F.col("metric") == "samples", F.col("value")).otherwise(F.signum("value")))


@query(
    "SELECT conv_id, turn, role, text, (SELECT count(*) FROM conversations) AS n_rows"
    " FROM conversations ORDER BY conv_id, turn LIMIT 10"
)
def preview_rows(spark, sf_dir):
    count, columns, rows = preview(table(spark, sf_dir, "conversations"), 10, ["conv_id", "turn"])
    return rows.select(*columns, F.lit(count).cast("bigint").alias("n_rows"))


@query(
    f"""WITH merged AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS source, doc_id, text,
      CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS labels FROM documents),
    {sql_split('s', 'merged', ('source', 'doc_id'))} SELECT doc_id, text, labels, split FROM s"""
)
def task_run(spark, sf_dir):
    """The merge task by name, from published sources to a published result."""
    root = scratch_path(spark, "task")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    for name, part in (("other", "lang <> 'en'"), ("english", "lang = 'en'")):
        rows = docs.where(part).drop("lang").withColumn("split", F.lit("train"))
        publish(rows, root, name, "validation")
    cfg = CleanConfig(
        root, ["other", "english"], key="doc_id", save=True, target="merged", revision="first"
    )
    run_task(spark, cfg)
    return read_named(spark, root, "merged", revision="first").select(
        "doc_id", "text", "labels", "split"
    )


@query(f"WITH {PROMPT_SQL} SELECT doc_id, input, instruction, output, split FROM s")
def prompt_task_run(spark, sf_dir):
    """The prompt task by name, from published test splits to a published result."""
    root = scratch_path(spark, "task")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    for name, part in (("other", "lang <> 'en'"), ("english", "lang = 'en'")):
        publish(docs.where(part).drop("lang").withColumn("split", F.lit("test")), root, name)
    cfg = CleanConfig(
        root, ["other", "english"], "PROMPT_MERGE_SPLIT_SAVE", "doc_id", separators=DOC_SEPARATORS, save=True, target="prompts"
    )
    return run_task(spark, cfg).select("doc_id", "input", "instruction", "output", "split")
