"""Vocabulary, lookups and supervised labels."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import tokens as K
from corpus_spark.operators.udf import map_batches, token_udf
from corpus_spark.operators.vectors import impute_mean_vectors, mean_pool


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[60] + [1] * 59, k=rng.randint(0, 40)))) for i in range(80)]
    rows[3] = (3, "")
    return spark.createDataFrame(rows, "id long, text string").cache()


@pytest.fixture(scope="module")
def vocab(docs):
    return K.build_vocab(docs, "text").cache()


def ids_by_hand(docs):
    counts = Counter(w for r in docs.collect() for w in r.text.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    return {"[PAD]": 0, "</s>": 1, **{w: i + 2 for i, w in enumerate(order)}}


def test_vocabulary(docs, vocab):
    assert {r.token: r.id for r in vocab.collect()} == ids_by_hand(docs)


def test_vocabulary_limits(docs):
    wanted = sorted(ids_by_hand(docs).items(), key=lambda e: e[1])
    small = K.build_vocab(docs, "text", max_size=10)
    assert sorted((r.token, r.id) for r in small.collect()) == sorted(wanted[:10])
    often = K.build_vocab(docs, "text", min_count=10**6)
    assert often.count() == 2


@pytest.mark.parametrize("head", [None, 8, 40])
def test_encode(docs, vocab, head, monkeypatch):
    if head:
        monkeypatch.setattr(K, "HEAD_ENTRIES", head)
    ids = ids_by_hand(docs)
    got = K.encode(docs, "text", vocab.where("token != 'w7'")).collect()
    assert len(got) == 80
    for r in got:
        wanted = [1 if w == "w7" else ids[w] for w in r.text.split()]
        assert r.input_ids == wanted


@pytest.mark.parametrize("head", [8, 10**6])
def test_repeated_and_null_rows_encode_alike_at_any_size(spark, vocab, monkeypatch, head):
    monkeypatch.setattr(K, "HEAD_ENTRIES", head)
    rows = [(1, "w1 w2 zzz w3"), (1, "w40 w41"), (None, "w1"), (None, None), (1, "w1 w2 zzz w3"), (2, "")]
    ids = {r.token: r.id for r in vocab.collect()}
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.text or "", r.input_ids) for r in K.encode(df, "text", vocab).collect() if r.text is not None)
    assert got == sorted((t, [ids.get(w, 1) for w in t.split()]) for _, t in rows if t is not None)


def test_special_tokens_are_cut_alike_by_default(spark):
    df = spark.createDataFrame([("foo</s> bar",)], "text string")
    words = K.build_vocab(df, "text")
    ids = {r.token: r.id for r in words.collect()}
    assert K.encode(df, "text", words).first().input_ids == [ids["foo"], 1, ids["bar"]]


def test_long_tokens_leave_the_head(spark):
    long = "x" * 500
    df = spark.createDataFrame([(f"{long} a {long}",)], "text string")
    words = K.build_vocab(df, "text")
    ids = {r.token: r.id for r in words.collect()}
    assert K.encode(df, "text", words).first().input_ids == [ids[long], ids["a"], ids[long]]


@pytest.mark.parametrize("head", [None, 8])
def test_round_trip(docs, vocab, head, monkeypatch):
    if head:
        monkeypatch.setattr(K, "HEAD_ENTRIES", head)
    ids = K.encode(docs, "text", vocab)
    back = K.decode(ids, "input_ids", vocab).collect()
    assert all(r.decoded == r.text for r in back)


def test_truncation_and_wrapping(docs, vocab):
    got = K.encode(docs, "text", vocab, max_len=5, bos_id=101, eos_id=102).collect()
    ids = ids_by_hand(docs)
    for r in got:
        assert r.input_ids == [101, *[ids[w] for w in r.text.split()][:3], 102]


def test_specials(spark):
    vocab = spark.createDataFrame([("a", 0, 1), ("</s>", 7, 0)], "token string, id bigint, n bigint")
    full, roles, added = K.ensure_specials(vocab)
    assert added == 1
    assert roles == {"pad": 8, "eos": 7, "bos": 7, "unk": 7}
    assert {r.token: r.id for r in full.collect()} == {"a": 0, "</s>": 7, "[PAD]": 8}
    same, roles, added = K.ensure_specials(full)
    assert added == 0 and same.count() == 3
    _, roles, added = K.ensure_specials(vocab, configured=["pad"])
    assert added == 0 and "pad" not in roles


def test_supervised_labels(spark):
    vocab = spark.createDataFrame(
        [("[PAD]", 0, 0), ("</s>", 1, 0), ("e", 5, 1), ("f", 6, 1), ("g", 7, 1), ("h", 8, 1)],
        "token string, id bigint, n bigint",
    )
    df = spark.createDataFrame([("e f", " g h")], "s string, t string")
    row = K.sft_encode(df, "s", "t", vocab, 10).first()
    assert row.input_ids == [5, 6, 7, 8] and row.labels == [-100, -100, 7, 8]
    row = K.sft_encode(df, "s", "t", vocab, 2).first()
    assert row.input_ids == [5, 6] and row.labels == [-100, -100]
    row = K.sft_encode_concat(df, "s", "t", vocab, 3).first()
    assert row.input_ids == [5, 6, 7] and row.labels == [-100, -100, 7]


def test_special_token_inside_text(spark):
    vocab = spark.createDataFrame([("</s>", 1, 0), ("x", 2, 1)], "token string, id bigint, n bigint")
    df = spark.createDataFrame([("x x</s>",)], "t string")
    assert K.encode(df, "t", vocab, unk_id=9, specials=["</s>"]).first().input_ids == [2, 2, 1]


def test_own_tokenizer(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    fn = token_udf(lambda text: [ord(c) for c in text])
    got = K.encode(df, "t", None, tokenizer=fn, max_len=2).collect()
    assert [r.input_ids for r in got] == [[97, 98], [], None]


def test_map_batches_may_change_the_row_count(spark):
    df = spark.range(0, 25, 1, 1)
    got = map_batches(df, lambda f: f.head(1), "id long", batch_rows=10).collect()
    assert [r.id for r in got] == [0, 10, 20]


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "id long, v array<double>")
    new = spark.createDataFrame([(3,)], "id long")
    got = {r.id: r.v for r in impute_mean_vectors(df, new, "id", "v").collect()}
    assert got[3] == [2.0, 4.0] and len(got) == 3


def test_mean_pool(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [3.0, 8.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "k int, v array<double>, m int")
    plain = {r.k: r.vector for r in mean_pool(df, "k", "v", "m", normalize=False).collect()}
    assert plain == {1: [2.0, 4.0], 2: [0.0, 0.0]}
    unit = {r.k: r.vector for r in mean_pool(df, "k", "v", "m").collect()}
    assert unit[1] == pytest.approx([0.447214, 0.894427], abs=1e-6)
    assert unit[2] == [0.0, 0.0]


def test_pairs_share_one_lookup(spark, monkeypatch):
    """NULL and empty texts, unknown and rare tokens; the rare ones take the join."""
    words = [("</s>", 0, 0), *[(f"w{i}", i, 9) for i in range(1, 9)]]
    vocab = spark.createDataFrame(words, "token string, id bigint, n bigint")
    rows = [(1, "w1 w8", " w2"), (2, "", "w7 w9"), (3, None, "w3"), (4, "w4", None), (5, "w5 w9 w6", "")]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    ids = {token: i for token, i, _ in words}

    def by_hand(text, room=None):
        return None if text is None else [ids.get(w, 3) for w in text.split()][:room]

    for head in (K.HEAD_ENTRIES, 4):
        monkeypatch.setattr(K, "HEAD_ENTRIES", head)
        got = {r.id: r for r in K.sft_encode(df, "s", "t", vocab, 4, unk_id=3, pad_id=-1).collect()}
        apart = {r.id: r for r in K.sft_encode_concat(df, "s", "t", vocab, 9, unk_id=3, eos_id=0).collect()}
        for i, s, t in rows:
            full = None if s is None or t is None else by_hand(s + t, 4)
            assert got[i].input_ids == full
            if full is not None:
                hidden = min(len(by_hand(s)), 4)
                assert got[i].labels == [-100] * hidden + full[hidden:]
                assert apart[i].input_ids == by_hand(s) + [0] + by_hand(t)
                assert apart[i].labels == [-100] * (len(by_hand(s)) + 1) + by_hand(t)
        assert set(got[1].asDict()) == {"id", "s", "t", "input_ids", "labels"}
