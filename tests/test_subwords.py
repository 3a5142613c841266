"""A pretrained byte-level vocabulary: against another library, round trips, in place of learnt words."""

from pathlib import Path

import pyarrow as pa
import pytest

from corpus_spark.catalog.training import RANK_FILE
from corpus_spark.operators import subwords as W
from corpus_spark.operators import tokens as K
from corpus_spark.operators.packing import pack_blocks

TEXTS = ["", "Hello  world,\n\tit's 2024!", "Étion dans le où 😀 漢字かな", "don't </s> <|endoftext|>", " " * 3000 + "x", "a" * 20_000, "é\u0301\x00\r\n ", "lowercase lowercase"]
pytestmark = pytest.mark.skipif(not Path(RANK_FILE).exists(), reason="no rank file")


@pytest.fixture(scope="module")
def encoded(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, text string")
    return K.encode(df, "text", None, tokenizer=W.subword_tokenizer(spark, RANK_FILE)).cache()


def test_ids_equal_those_of_another_library(encoded):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(str(Path(RANK_FILE).with_suffix(".json")))
    other.encode_special_tokens = True
    got = {r.id: r.input_ids for r in encoded.collect()}
    assert got.pop(len(TEXTS)) is None
    assert got == {i: other.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("head", [None, 1000])
def test_round_trip(spark, encoded, head, monkeypatch):
    if head:
        monkeypatch.setattr(K, "HEAD_ENTRIES", head)
    back = W.subword_decode(encoded, "input_ids", W.subword_vocab(spark, RANK_FILE)).collect()
    assert len(back) == len(TEXTS) + 1 and all(r.decoded == r.text for r in back)


def test_ids_of_a_batch_are_no_python_objects(spark):
    """Batches go in and out as Arrow arrays; a NULL among texts, a slice and no text at all."""
    run = W.subword_tokenizer(spark, RANK_FILE).func
    got = run(pa.array([None, "a b", None, "", "c"]).slice(1))
    assert got.type == pa.list_(pa.int64()) and [x is None for x in got.to_pylist()] == [False, True, False, False]
    assert [len(x) for x in got.to_pylist() if x is not None] == [2, 0, 1]
    assert len(run(pa.array([], pa.string()))) == 0


def test_cut_texts_unknown_and_skipped_ids(spark):
    vocab = W.subword_vocab(spark, RANK_FILE)
    smile = K.encode(spark.createDataFrame([("x😀",)], "text string"), "text", None, tokenizer=W.subword_tokenizer(spark, RANK_FILE), max_len=2)
    row = W.subword_decode(smile, "input_ids", vocab).first()
    assert row.decoded.startswith("x") and "\ufffd" in row.decoded
    df = spark.createDataFrame([([0, 10**9, 1, None],)], "ids array<long>")
    assert W.subword_decode(df, "ids", vocab, skip_ids=[1]).first().decoded == "!"


def test_vocabulary_is_whole_and_large_files_are_refused(spark, monkeypatch):
    ids = sorted(r.id for r in W.subword_vocab(spark, RANK_FILE).select("id").collect())
    assert ids == list(range(50_256))
    monkeypatch.setattr(W, "MAX_FILE_BYTES", 1000)
    with pytest.raises(ValueError, match="more than 1000"):
        W.subword_tokenizer(spark, RANK_FILE)


def test_blocks_and_labels_of_subwords(spark, encoded):
    blocks = pack_blocks(encoded.where("text is not null"), "input_ids", 16, "id", 100).collect()
    assert blocks and all(len(r.input_ids) == 16 for r in blocks)
    pair = spark.createDataFrame([("Say hello:", " hello")], "s string, t string")
    row = K.sft_encode(pair, "s", "t", None, 32, pad_id=-1, tokenizer=W.subword_tokenizer(spark, RANK_FILE)).first()
    assert row.labels.count(-100) == 3 and row.labels[3:] == row.input_ids[3:]
