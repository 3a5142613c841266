"""The decoder, and accuracy on documents that were not learnt from."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import flat_bytes
from corpus_spark.llm.toxicity import character_model, crc_fold, learn_toxicity, restore, score_toxicity

BAD = ["stupid", "idiot", "pathetic", "worthless"]
GOOD = "the stone and river that with garden under little morning water paper window".split()


def text(rng, toxic, noisy=False):
    w = rng.choices(GOOD, k=rng.randrange(15, 60))
    if toxic:
        for _ in range(3):
            bad = rng.choice(BAD)
            w.insert(rng.randrange(len(w)), bad.replace("i", "1").replace("t", "7") if noisy else bad)
    return " ".join(w) + rng.choice([".", "!", ""])


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels


@pytest.fixture(scope="module")
def model(data):
    return learn_toxicity(*data)


def test_restore(data):
    lm = character_model(data[0], "text")
    for noisy, clean in (("1d1ot", "idiot"), ("p4thet1c", "pathetic"), ("stuuuupid", "stupid"), ("w-o-r-t-h-less", "worthless"), ("7he", "the")):
        assert restore(noisy, lm) == clean
    assert restore("", lm) == ""


def test_held_out_accuracy(data, model):
    docs, labels = data
    scored = score_toxicity(docs, model).join(labels.dropna(), "doc_id").where(crc_fold("doc_id", 5) == 0)
    rows = scored.collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.97


def test_noisy_words_count_like_clean_ones(model):
    rng = random.Random(9)
    noisy = [text(rng, True, noisy=True) for _ in range(30)] + ["the river s t u p i d and i d i o t water stupid"]
    clean = [text(rng, False) for _ in range(30)]
    assert (model.score(*flat_bytes(pa.array(noisy)), {}) > 0.5).mean() > 0.9
    assert (model.score(*flat_bytes(pa.array(clean)), {}) < 0.5).all()


def test_odd_rows(spark, data, model):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "!!! ***"), (4, "1" * 5000), (5, "a " * 3000), (5, "a " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))
    got = score_toxicity(docs, model).collect()
    assert len(got) == 7 and all(r.score < 0.5 and r.key == "x" for r in got)
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_all_labelled_documents_are_learnt_from(spark):
    """Many copies of a plain document beside a few toxic ones: no draw of the rows may lose these."""
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 1500 == 0, "the river wretched stone").otherwise("the river water stone").alias("text"),
        (F.col("id") % 1500 == 0).cast("int").alias("toxic"),
    )
    train = rows.where(crc_fold("doc_id", 5) != 0)
    n, bad = train.count(), train.where("toxic = 1").count()
    model = learn_toxicity(rows, rows)
    toxic, plain = model.score(*flat_bytes(pa.array(["the wretched river", "the river"])), {})
    assert bad > 10 and n > 20_000 and toxic > 0.9 and plain < 0.01
    # A word's cost is its negative log share of the words of all rows learnt from.
    assert model.lexicon["the"] == pytest.approx(np.log(4))
    assert model.lexicon["wretched"] == pytest.approx(np.log(4 * n / bad))


def test_without_labels(data):
    docs, labels = data
    assert learn_toxicity(docs, labels.limit(0)).share == 0.0
    only = learn_toxicity(docs, labels.where("toxic = 1"))
    assert score_toxicity(docs, only).where("score <> 1").count() == 0


@pytest.mark.parametrize(
    "noisy",
    ["the river a s t u p i d stone", "the s t u p i d i d i o t stone", "that y o u i d i o t river", "the 1d10+ stone", "river id!o+, stone", "the 570p1+ river"],
)
def test_noise_without_a_plain_toxic_word(spark, noisy):
    rng = random.Random(3)
    bad = ["stupid", "idiot", "stopit"]
    rows = []
    for i in range(400):
        w = rng.choices([*GOOD, "you", "a"], k=20) + [rng.choice(bad)] * (i % 4 == 0)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = learn_toxicity(docs, docs)
    toxic, clean = model.score(*flat_bytes(pa.array([noisy, "the river a s t o n e and w a t e r stone 1984 the!! $"])), {})
    assert toxic > 0.5 > clean
