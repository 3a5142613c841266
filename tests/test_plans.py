"""Cleaning plans, the stream and the classifier."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from corpus_spark.catalog import QUERIES
from corpus_spark.catalog.registry import DOC_SEPARATORS
from corpus_spark.operators import schema as S
from corpus_spark.operators.order import split_counts, split_exact
from corpus_spark.plans import classify, clean, training
from corpus_spark.plans.evaluate import evaluate
from corpus_spark.sources import publish, read_named
from corpus_spark.streaming import clean_step, clean_stream, hash_split

U = "　"


def sizes(df):
    return {r[0]: r[1] for r in df.groupBy("split").count().collect()}


def test_roles():
    assert S.intersection(["a", "a", "b"], ["b", "a"]) == ["a", "a", "b"]
    assert S.resolve_role(["content", "0"], ["0", "content"], "text") == "content"
    assert S.resolve_role(["x"], ["0", "content"], "text") == "text"


def test_labels(spark):
    df = spark.createDataFrame([("ai写的",), ("人类写的",), ("?",), (None,)], "target string")
    got = [r.labels for r in S.encode_label(df, {"人类写的": 1, "ai写的": 0}).collect()]
    assert got == [0, 1, None, None]
    unknown = S.unknown_labels(df, {"人类写的": 1, "ai写的": 0}, "target").collect()
    assert sorted((r.target or "", r.n) for r in unknown) == [("", 1), ("?", 1)]


def test_prompt_outputs(spark):
    df = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2), ("t", None)], "input string, label int")
    assert [r.output for r in S.prompt_rows(df).collect()] == ["AI编写", "人类编写", None, None]
    text = spark.createDataFrame([("t", "0")], "input string, label string")
    assert S.prompt_rows(text).first().output is None


def test_union_needs_equal_columns(spark):
    a = spark.createDataFrame([("x", 1)], "text string, labels int")
    b = spark.createDataFrame([("x", 2)], "labels2 string, labels long")
    c = spark.createDataFrame([("y", 2)], "text string, labels long")
    assert S.union_sources([a, c], "labels").count() == 2
    with pytest.raises(ValueError, match="source 1"):
        S.union_sources([a, b])
    with pytest.raises(ValueError, match="source 1"):
        S.union_sources([a, c.withColumn("labels", F.lit("2"))], "labels")


def test_two_sources(spark):
    ai = spark.createDataFrame([(i, f"a{i}") for i in range(30)], "id long, text string")
    human = spark.createDataFrame([(i, f"h{i}") for i in range(100)], "id long, text string")
    got = clean.clean_two_sources(ai, human, number=20, zoom=2)
    assert sizes(got) == {s: n for s, n in split_counts(60)}
    targets = {r[0]: r[1] for r in got.groupBy("target").count().collect()}
    assert targets == {"ai写的": 20, "人类写的": 40}
    assert {r.id for r in got.where("source = 1").collect()} == set(range(40))


def test_merge_takes_index_as_label_and_trims(spark):
    a = spark.createDataFrame([(i, f"a{i}", 7) for i in range(60)], "id long, content string, labels int")
    b = spark.createDataFrame([(f"b{i}",) for i in range(40)], "`0` string")
    with_id = clean.with_row_key(b, "id")
    got = clean.merge_and_split([a, with_id], "id", ["0", "content"], train_length=20)
    assert sizes(got) == {"train": 20, "validation": 10, "test": 10}
    whole = clean.merge_and_split([a, with_id], "id", ["0", "content"])
    assert {(r.labels, r.source) for r in whole.collect()} == {(7, 0), (1, 1)}
    assert sizes(whole) == {"train": 80, "validation": 10, "test": 10}


def test_prompt_plan_and_pipe_source(spark):
    a = spark.createDataFrame([(1, "x|||||y"), (2, "toolong" * 9)], "id long, text string")
    b = spark.createDataFrame([(1, f"p{U}{U}q")], "id long, text string")
    got = clean.prompt_merge_and_split([a, b], max_length=20, names=["multi_news", "other"])
    rows = {(r.source, r.id): (r.input, r.output) for r in got.collect()}
    assert rows == {(0, 1): ("x\ny", "AI编写"), (1, 1): ("p\nq", "人类编写")}


def test_tasks(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(50).select("id", F.concat(F.lit("t"), "id").alias("text"))
    publish(df.withColumn("split", F.lit("train")), root, "one", "validation")
    labels = (F.col("id") % 2).alias("labels")
    df.select("id", "text", labels).coalesce(1).write.option("header", True).csv(f"{root}/two.csv")
    cfg = clean.CleanConfig(root, ["one"], save=True, target="out", revision="r1")
    clean.run_task(spark, cfg)
    assert read_named(spark, root, "out", split="test", revision="r1").count() == 5
    prompt = clean.CleanConfig(root, ["two.csv"], task="PROMPT_MERGE_SPLIT_SAVE")
    outputs = clean.run_task(spark, prompt).groupBy("output").count().collect()
    assert {r[0]: r[1] for r in outputs} == {"AI编写": 25, "人类编写": 25}
    with pytest.raises(ValueError):
        clean.run_task(spark, clean.CleanConfig(root, [], task="TO_CLEAN"))


def test_stream_equals_batch(spark, tmp_path):
    texts = [(i, "\n\n".join(["w" * (i % 7)] * (i % 5 + 1))) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, text string")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.where("id < 120").repartition(3).write.parquet(source)

    def step(rows):
        return clean_step(rows, "id", max_length=10)

    clean_stream(spark, source, out, state, df.schema, step, "id")
    first = spark.read.parquet(out).count()
    assert first == step(df.where("id < 120")).count()
    df.where("id >= 120").write.mode("append").parquet(source)
    clean_stream(spark, source, out, state, df.schema, step, "id")
    streamed = spark.read.parquet(out)
    wanted = step(df).withColumn("split", hash_split(5, "id"))
    assert sorted(streamed.select(wanted.columns).collect()) == sorted(wanted.collect())


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_query_takes_one_file_or_a_folder(spark, tmp_path, files):
    """Three files are a folder, one is a plain file, none is an empty folder table."""
    texts = [(i, "a\nb" * (i % 5), i) for i in range(40 if files else 0)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")
    df.repartition(max(files, 1)).write.parquet(str(tmp_path / "written"))
    if files == 1:
        next((tmp_path / "written").glob("part-*")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "written").rename(tmp_path / "documents.parquet")
    got = QUERIES["stream_clean"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "input", "instruction", "output", "split"]
    wanted = clean_step(df, "doc_id", index=1, separators=DOC_SEPARATORS).select("doc_id", "input")
    assert sorted(got.select("doc_id", "input").collect()) == sorted(wanted.collect())
    assert got.count() == len(texts)


def test_training_batches(spark):
    rows = [(i, "a b c"[: 1 + 2 * (i % 3)], i % 2) for i in range(20)]
    df = split_exact(spark.createDataFrame(rows, "id long, text string, labels int"), "id")
    words = spark.createDataFrame(
        [("[PAD]", 0, 0), ("</s>", 1, 0), ("a", 2, 1), ("b", 3, 1), ("c", 4, 1)],
        "token string, id bigint, n bigint",
    )
    data = training.classifier_data(df, "text", "labels", "id", words, 2, {"train": 6})
    assert data.where("split = 'train'").count() == 6
    batches = training.classifier_batches(data.where("split = 'train'"), "id", 4).collect()
    assert sorted(r.n_rows for r in batches) == [2, 4]
    for r in batches:
        longest = max(len(x) for x in r.input_ids)
        assert all(len(x) == longest for x in r.input_ids + r.attention_mask)
    sft = training.sft_data(df, "text", "labels", "id", words, 64)
    batch = training.sft_batches(sft, "id", 4).first()
    assert all(m == [int(x != 0) for x in ids] for m, ids in zip(batch.attention_mask, batch.input_ids))
    assert all(y[-1] in (1, -100) for y in batch.labels)


def test_limits_of_packed_rows(spark):
    df = spark.createDataFrame([(i, "a b c d") for i in range(30)], "id long, text string")
    words = spark.createDataFrame([("a", 2, 1), ("b", 3, 1)], "token string, id bigint, n bigint")
    split = split_exact(df, "id")
    blocks = training.pretrain_data(split, "text", "id", words, 8, max_samples={"train": 3, "test": 99})
    assert sizes(blocks) == {"train": 3, "validation": 1, "test": 1}
    packed, ratio = training.constant_length_data(split, "text", "id", words, 8, max_train=5)
    row = ratio.first()
    assert row.ratio == row.characters / row.tokens
    assert {r.split for r in packed.collect()} == {"train", "validation"}


def test_classifier_metrics_match_the_library(spark):
    rows = [(i, ("good fine nice " if i % 2 else "bad poor sad ") * (1 + i % 3), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, labels int")
    model = classify.train_text_classifier(df, features=64, iterations=5)
    scored = classify.predict_labels(model, df).cache()
    got = {r.metric: r.value for r in evaluate(scored, "logits", "labels", "score").collect()}
    library = scored.select(F.col("labels").cast("double").alias("label"), F.col("pred").cast("double").alias("prediction"))
    for ours, theirs in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(library))
    assert got["accuracy"] > 0.9 and got["roc_auc"] > 0.9


def test_made_keys_do_not_depend_on_partitions(spark):
    rows = [(f"t{i % 40}", None if i % 3 else "x") for i in range(200)]
    df = spark.createDataFrame(rows, "text string, other string")
    labels = []
    for parts in (1, 200):
        keyed = clean.with_row_key(df.repartition(parts), "id")
        assert keyed.count() == 200 == keyed.select("id").distinct().count()
        split = clean.merge_and_split([df.repartition(parts)], "id")
        labels.append({(r.id, r.text): r.split for r in split.collect()})
    assert labels[0] == labels[1] and len(labels[0]) == 200


def test_a_saved_task_leaves_no_scratch(spark, tmp_path):
    import glob

    from corpus_spark import session

    publish_rows = spark.createDataFrame([(i, f"t{i}", "train") for i in range(30)], "id long, text string, split string")
    IO_root = str(tmp_path)
    clean.publish(publish_rows, IO_root, "one", "validation")
    before = set(glob.glob(session._scratch_folder(spark) + "/*"))
    cfg = clean.CleanConfig(IO_root, ["one"], save=True, target="out")
    assert clean.run_task(spark, cfg).count() == 30
    assert set(glob.glob(session._scratch_folder(spark) + "/*")) == before


def test_keys_of_rows_that_join_to_one_text(spark):
    """Separators inside values do not make two rows one."""
    rows = [("a\x1f=b", "c"), ("a", "b\x1f=c"), ("a1=", None), ("a", "1=-"), (None, "-"), ("-", None), ("", "")]
    keyed = clean.with_row_key(spark.createDataFrame(rows, "x string, y string"), "id")
    assert keyed.select("id").distinct().count() == len(rows)


@pytest.mark.parametrize("head", [None, 4])
def test_count_classifier_equals_counting_by_hand(spark, head, monkeypatch):
    if head:
        monkeypatch.setattr("corpus_spark.operators.tokens.HEAD_ENTRIES", head)
    rng = random.Random(6)
    texts = {"a": "x y z".split(), "b": "y z u".split(), "c": "u v w".split()}
    rows = [(" ".join(rng.choices(texts[c], k=rng.randrange(7))), c) for c in "aaabbccc" * 6] + [(None, "b"), ("x q", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, labels string")
    test = spark.createDataFrame([(0, "x y new"), (1, ""), (2, None), (3, "u u u w"), (4, "new")], "id int, text string")
    model = classify.train_count_classifier(df, smoothing=0.5)
    got = {r.id: r for r in classify.predict_by_counts(model, test).collect()}
    counts = {c: Counter(w for t, k in rows if k == c and t for w in t.split()) for c in "abc"}
    known = len(set().union(*counts.values()))
    for i, text in [(0, "x y new"), (1, ""), (2, ""), (3, "u u u w"), (4, "new")]:
        logits = [
            math.log(sum(k == c for _, k in rows) / 49)
            + sum(math.log((counts[c][w] + 0.5) / (counts[c].total() + 0.5 * known)) for w in text.split())
            for c in "abc"
        ]
        assert got[i].logits == pytest.approx(logits) and got[i].pred == "abc"[logits.index(max(logits))]
        assert sum(got[i].probabilities) == pytest.approx(1)
    with pytest.raises(ValueError, match="0 classes"):
        classify.train_count_classifier(df.limit(0))
