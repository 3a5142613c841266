"""Queries: metrics, rewards, vectors and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_spark.catalog.registry import (
    LABELLED_SQL,
    PAIRS_SQL,
    labelled,
    query,
    rounded,
    sql_shuffle,
    sql_split,
    sql_words,
    table,
    turn_pairs,
)
from corpus_spark.functions import argmax, words
from corpus_spark.operators import metrics as M
from corpus_spark.operators import vectors as V
from corpus_spark.operators.order import split_exact
from corpus_spark.operators.udf import apply_metrics
from corpus_spark.plans.classify import predict_by_counts, predict_labels, train_count_classifier, train_text_classifier
from corpus_spark.plans.evaluate import evaluate, reward_report as report, reward_summary as summary
from corpus_spark.session import materialize


def sql_scores(source: str) -> str:
    """Accuracy and weighted scores of (y, p) rows as (metric, value)."""
    return f"""
cls_ AS (SELECT y AS c FROM {source} UNION SELECT p FROM {source}),
sup_ AS (SELECT y AS c, count(*) AS support FROM {source} GROUP BY y),
prd_ AS (SELECT p AS c, count(*) AS predicted FROM {source} GROUP BY p),
hit_ AS (SELECT y AS c, count(*) AS hits FROM {source} WHERE y = p GROUP BY y),
per_ AS (
  SELECT coalesce(support, 0) AS s, coalesce(hits, 0) AS h,
    CASE WHEN coalesce(predicted, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(hits, 0)::DOUBLE / predicted END AS pr,
    CASE WHEN coalesce(support, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(hits, 0)::DOUBLE / support END AS re
  FROM cls_ LEFT JOIN sup_ USING (c) LEFT JOIN prd_ USING (c) LEFT JOIN hit_ USING (c)),
m_ AS (
  SELECT sum(h)::DOUBLE / sum(s) AS accuracy, sum(pr * s) / sum(s) AS "precision", sum(re * s) / sum(s) AS recall,
    sum(CASE WHEN pr + re = 0 THEN 0.0::DOUBLE ELSE 2 * pr * re / (pr + re) END * s) / sum(s) AS f1 FROM per_),
scores AS (
  SELECT metric, round(value, 6) AS value
  FROM (UNPIVOT m_ ON accuracy, "precision", recall, f1 INTO NAME metric VALUE value))"""


def _round_values(df):
    return df.withColumn("value", rounded("value"))


@query(
    f"""WITH yp AS (SELECT label AS y, list_position(embedding, list_max(embedding)) - 1 AS p
    FROM embeddings), {sql_scores('yp')} SELECT * FROM scores"""
)
def argmax_metrics(spark, sf_dir):
    """Evaluation of logits: a vector against its label."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("embedding").alias("logits"), "label"
    )
    return _round_values(evaluate(rows, "logits", "label"))


@query(
    f"""SELECT label AS label, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS pred,
    count(*) AS n FROM embeddings GROUP BY ALL"""
)
def confusion_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        argmax(F.col("embedding")).alias("guess"), "label"
    )
    return M.confusion(rows, "label", "guess")


@query(
    f"WITH yp AS (SELECT quality AS y, toxic AS p FROM labels), {sql_scores('yp')} SELECT * FROM scores"
)
def weighted_prf(spark, sf_dir):
    return _round_values(M.weighted_scores(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query(
    """WITH m AS (SELECT avg((quality = 1 - toxic)::INTEGER)::DOUBLE AS accuracy,
      2.0::DOUBLE * count(*) FILTER (quality = 1 AND toxic = 0)
        / (count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 0)) AS f1 FROM labels)
    SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON accuracy, f1 INTO NAME metric VALUE value)"""
)
def binary_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("pred", 1 - F.col("toxic"))
    return _round_values(M.binary_scores(rows, "quality", "pred"))


@query(
    "SELECT 'accuracy' AS metric, round(avg((quality = 1 - toxic)::INTEGER)::DOUBLE, 6) AS value FROM labels"
)
def accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("pred", 1 - F.col("toxic"))
    return _round_values(M.accuracy(rows, "quality", "pred"))


@query(
    f"""WITH {LABELLED_SQL}, g AS (
      SELECT n_chars, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg
      FROM labelled GROUP BY n_chars),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY n_chars) - neg / 2.0::DOUBLE AS below FROM g)
    SELECT 'roc_auc' AS metric, round(sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)), 6) AS value FROM c"""
)
def roc_auc(spark, sf_dir):
    """Text length as a score for quality."""
    return _round_values(M.roc_auc(labelled(spark, sf_dir), "quality", "n_chars"))


@query(
    """WITH g AS (SELECT value AS s, count(*) FILTER (event_type = 'purchase') AS pos,
      count(*) FILTER (event_type <> 'purchase') AS neg FROM events GROUP BY value),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg / 2.0::DOUBLE AS below FROM g)
    SELECT 'roc_auc' AS metric, round(sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)), 6) AS value FROM c"""
)
def roc_auc_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("y"), "value"
    )
    return _round_values(M.roc_auc(rows, "y", "value"))


@query(
    f"""WITH w AS (SELECT list_transform({sql_words('text')}, lambda x: length(x)) AS l FROM conversations),
    p AS (SELECT unnest(l[2:]) AS a, unnest(l[:len(l) - 1]) AS b FROM w WHERE len(l) > 1)
    SELECT count(*) FILTER (a = b)::BIGINT AS hits, count(*) AS total,
      round(count(*) FILTER (a = b)::DOUBLE / count(*), 6) AS accuracy FROM p"""
)
def next_token_accuracy(spark, sf_dir):
    """Word lengths as tokens, each predicting that its length repeats."""
    rows = table(spark, sf_dir, "conversations").select(
        F.transform(words(F.col("text")), lambda w: F.length(w)).alias("ids")
    )
    return M.next_token_accuracy(rows, "ids", "ids").withColumn("accuracy", rounded("accuracy"))


@query(
    f"""WITH w AS (SELECT list_transform({sql_words('text')}, lambda x: length(x)) AS l FROM conversations),
    p AS (SELECT unnest(l[2:]) AS a, unnest(l[:len(l) - 1]) AS b FROM w WHERE len(l) > 1)
    SELECT count(*) FILTER (a = b AND a <> 2)::BIGINT AS hits, count(*) FILTER (a <> 2) AS total,
      round(count(*) FILTER (a = b AND a <> 2)::DOUBLE / count(*) FILTER (a <> 2), 6) AS accuracy FROM p"""
)
def next_token_accuracy_ignored(spark, sf_dir):
    """The same with one token that does not count."""
    rows = table(spark, sf_dir, "conversations").select(
        F.transform(words(F.col("text")), lambda w: F.length(w)).alias("ids")
    )
    return M.next_token_accuracy(rows, "ids", "ids", ignore_index=2).withColumn("accuracy", rounded("accuracy"))


@query(
    """WITH m AS (SELECT avg((quality = 1 - toxic)::INTEGER)::DOUBLE AS accuracy,
      2.0::DOUBLE * count(*) FILTER (quality = 1 AND toxic = 0)
        / (count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 0)) AS f1, count(*)::DOUBLE AS "rows" FROM labels)
    SELECT metric, round(value, 6) AS value FROM (UNPIVOT m ON f1, accuracy, "rows" INTO NAME metric VALUE value)"""
)
def metric_functions(spark, sf_dir):
    """A caller's metric functions next to those of the library."""

    def rows_seen(df):
        return df.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), "value")

    rows = table(spark, sf_dir, "labels").withColumn("pred", 1 - F.col("toxic"))
    return _round_values(apply_metrics(rows, [lambda df: M.binary_scores(df, "quality", "pred"), rows_seen]))


@query(
    """SELECT event_type, round(avg(value / 100), 6) AS loss, round(exp(avg(value / 100)), 6) AS perplexity
    FROM events GROUP BY event_type"""
)
def perplexity(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type", (F.col("value") / 100).alias("nll")
    )
    return M.perplexity(events, "nll", ["event_type"]).select(
        "event_type", rounded("loss").alias("loss"), rounded("perplexity").alias("perplexity")
    )


@query(
    """SELECT quality, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM labels), 6) AS share
    FROM labels GROUP BY quality"""
)
def label_distribution(spark, sf_dir):
    shares = M.label_distribution(table(spark, sf_dir, "labels"), "quality")
    return shares.withColumn("share", rounded("share"))


@query(
    f"""WITH {sql_split('s', 'documents')} SELECT split, count(*) AS n,
    least(count(*), CASE split WHEN 'train' THEN 500 WHEN 'test' THEN 5000 ELSE count(*) END)::BIGINT AS samples
    FROM s GROUP BY split"""
)
def effective_samples(spark, sf_dir):
    rows = split_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return M.effective_samples(rows, {"train": 500, "test": 5000})


# --- rewards ---------------------------------------------------------------


def _rewards(spark, sf_dir):
    pairs = turn_pairs(spark, sf_dir)
    return pairs.select(
        "rid",
        F.col("question").alias("query"),
        F.concat(F.lit(" "), "reply").alias("response_before"),
        F.concat(F.lit(" / "), "reply").alias("response_after"),
        F.length("question").cast("double").alias("reward_before"),
        F.length("reply").cast("double").alias("reward_after"),
    )


@query(
    f"""WITH {PAIRS_SQL}
    SELECT 'reward_before' AS "column", round(avg(length(question)), 6) AS mean,
      round(median(length(question))::DOUBLE, 6) AS median FROM pairs
    UNION ALL
    SELECT 'reward_after', round(avg(length(reply)), 6), round(median(length(reply))::DOUBLE, 6) FROM pairs"""
)
def reward_summary(spark, sf_dir):
    result = summary(_rewards(spark, sf_dir))
    return result.select("column", rounded("mean").alias("mean"), rounded("median").alias("median"))


@query(
    f"""WITH {PAIRS_SQL} SELECT rid, question || ' ' || reply AS text_before, question || ' / ' || reply AS text_after,
    length(question)::DOUBLE AS reward_before, length(reply)::DOUBLE AS reward_after
    FROM pairs ORDER BY {sql_shuffle(5, 'rid')}, rid LIMIT 16"""
)
def reward_report(spark, sf_dir):
    return report(_rewards(spark, sf_dir), "rid")


# --- vectors ---------------------------------------------------------------


@query(
    """WITH t AS (SELECT label, CASE WHEN embedding[1] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w,
      unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    p AS (SELECT label, pos, sum(v * w) / greatest(sum(w), 1e-9::DOUBLE) AS m FROM t GROUP BY label, pos),
    n AS (SELECT *, greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12::DOUBLE) AS norm FROM p)
    SELECT label, pos::INTEGER AS pos, round(m / norm, 6) AS value FROM n"""
)
def mean_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "mask", (F.get("embedding", F.lit(0)) > 0).cast("int")
    )
    pooled = V.mean_pool(rows, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("vector").alias("pos", "value")).withColumn(
        "value", rounded("value")
    )


@query(
    """WITH t AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    m AS (SELECT pos, avg(v)::FLOAT AS v FROM t GROUP BY pos)
    SELECT vec_id, pos::INTEGER AS pos, round(v::DOUBLE, 6) AS value FROM (
      SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings
      UNION ALL SELECT -1 - item_id, v, pos FROM benchmark, m)"""
)
def impute_mean_vectors(spark, sf_dir):
    new = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("vec_id"))
    full = V.impute_mean_vectors(table(spark, sf_dir, "embeddings"), new, "vec_id", "embedding")
    return full.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "pos", rounded(F.col("v").cast("double")).alias("value")
    )


# --- classifier ------------------------------------------------------------


@query(
    f"""WITH {LABELLED_SQL}, {sql_split('s', 'labelled')}
    SELECT 'scored' AS kind, split || ' ' || quality AS name, count(*) AS n FROM s WHERE split <> 'train' GROUP BY split, quality
    UNION ALL SELECT 'outside 0..1', 'score', 0
    UNION ALL SELECT 'in range', unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']), 1"""
)
def classifier(spark, sf_dir):
    """Train on one part of the labelled documents and score the rest.

    A result that holds for any good model: rows scored by split and label, scores that
    are no probabilities, and whether each metric lies between 0 and 1.
    """
    rows = labelled(spark, sf_dir).select("doc_id", "text", F.col("quality").alias("labels"))
    rows = split_exact(rows, "doc_id")
    model = train_text_classifier(rows.where("split = 'train'"))
    scored = materialize(predict_labels(model, rows.where("split <> 'train'")), "scored")
    known = scored.groupBy(F.lit("scored").alias("kind"), F.concat_ws(" ", "split", "labels").alias("name")).agg(F.count("*").alias("n"))
    inside = F.coalesce(F.col("score").between(0, 1), F.lit(False))
    outside = scored.agg(F.count_if(~inside).alias("n"))
    outside = outside.select(F.lit("outside 0..1").alias("kind"), F.lit("score").alias("name"), "n")
    metrics = evaluate(scored, "logits", "labels", "score")
    ranged = F.coalesce(F.col("value").between(0, 1), F.lit(False)).cast("bigint")
    metrics = metrics.select(F.lit("in range").alias("kind"), F.col("metric").alias("name"), ranged.alias("n"))
    return known.unionByName(outside).unionByName(metrics)


BAYES_SQL = f"""{LABELLED_SQL}, {sql_split('sp', 'labelled')},
w AS (SELECT doc_id, split, quality, unnest({sql_words('text')}) AS token FROM sp),
tr AS (SELECT quality AS c, count(*)::DOUBLE AS r FROM sp WHERE split = 'train' GROUP BY c),
cnt AS (SELECT token, quality AS c, count(*) AS n FROM w WHERE split = 'train' GROUP BY ALL),
tot AS (SELECT c, sum(n)::DOUBLE + (SELECT count(DISTINCT token) FROM cnt) AS t FROM cnt GROUP BY c),
adds AS (SELECT w.doc_id, cnt.c, sum(ln(n + 1)) AS s FROM w JOIN cnt USING (token) GROUP BY ALL),
lens AS (SELECT doc_id, count(*) AS k FROM w GROUP BY doc_id),
logit AS (
  SELECT sp.doc_id, sp.split, sp.quality, tr.c,
    ln(r / (SELECT sum(r) FROM tr)) - coalesce(k, 0) * ln(t) + coalesce(s, 0) AS z
  FROM sp CROSS JOIN tr JOIN tot USING (c) LEFT JOIN lens ON lens.doc_id = sp.doc_id
  LEFT JOIN adds ON adds.doc_id = sp.doc_id AND adds.c = tr.c WHERE split <> 'train'),
scored AS (
  SELECT doc_id, split, quality AS labels, round(max(z) FILTER (c = 0), 3) AS logit_0,
    round(max(z) FILTER (c = 1), 3) AS logit_1, arg_max(c, z) AS pred FROM logit GROUP BY ALL)"""


def _by_counts(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "text", F.col("quality").alias("labels"))
    rows = split_exact(rows, "doc_id")
    return predict_by_counts(train_count_classifier(rows.where("split = 'train'")), rows.where("split <> 'train'"))


@query(f"WITH {BAYES_SQL} SELECT * FROM scored")
def count_classifier(spark, sf_dir):
    """Every score of a classifier whose model is counts, which SQL can count again."""
    logit = [F.round(F.get("logits", F.lit(i)), 3).alias(f"logit_{i}") for i in (0, 1)]
    return _by_counts(spark, sf_dir).select("doc_id", "split", "labels", *logit, "pred")


@query(f"WITH {BAYES_SQL} SELECT split, round(avg((labels = pred)::DOUBLE), 6) AS accuracy, count(*) AS n FROM scored GROUP BY split")
def count_classifier_accuracy(spark, sf_dir):
    """The share of held-out rows that the classifier labels right, by split."""
    scored = _by_counts(spark, sf_dir)
    right = F.avg((F.col("labels") == F.col("pred")).cast("double"))
    return scored.groupBy("split").agg(F.round(right, 6).alias("accuracy"), F.count("*").alias("n"))
