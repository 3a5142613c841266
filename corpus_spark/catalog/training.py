"""Queries: vocabulary, encoding, packing, batches and training rows."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.catalog.registry import (
    LABELLED_SQL,
    PAIRS_SQL,
    labelled,
    lit,
    query,
    sql_encode,
    sql_join,
    sql_mask,
    sql_pad,
    sql_shuffle,
    sql_split,
    sql_template,
    sql_vocab,
    sql_words,
    table,
    turn_pairs,
)
from corpus_spark.constants import (
    EOS_ID,
    LABEL_TO_TARGET,
    RATIO_EXAMPLES,
    SEQ2SEQ_OPTIONS,
    SEQ2SEQ_PROMPT,
    TARGET_TO_LABEL,
    TRAIN_OPTIONS,
    TRAIN_PROMPT,
    UNK_ID,
)
from corpus_spark.functions import attention_mask, join_ids
from corpus_spark.functions.text import tokens
from corpus_spark.operators import metrics as M
from corpus_spark.operators import packing as P
from corpus_spark.operators import subwords as W
from corpus_spark.operators import tokens as K
from corpus_spark.operators.order import exact_rank, head_n, split_exact
from corpus_spark.operators.schema import decode_label
from corpus_spark.operators.udf import map_batches as run_batches
from corpus_spark.operators.udf import token_udf
from corpus_spark.plans import training as T
from corpus_spark.session import materialize
from corpus_spark.sources import spread

DOC_TEXTS = "SELECT text FROM documents"
RANK_FILE = os.environ.get("CORPUS_RANK_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
TURN_TEXTS = "SELECT text FROM conversations"
PROMPT_SQL = sql_template(TRAIN_PROMPT, options_=lit(TRAIN_OPTIONS), sentence1="text")
TURNS_SQL = "turns AS (SELECT *, conv_id || ':' || turn AS rid FROM conversations)"


def _documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _turns(spark, sf_dir) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.withColumn("rid", F.concat_ws(":", "conv_id", "turn"))


def _doc_vocab(spark, sf_dir, size: int | None = None) -> DataFrame:
    return K.build_vocab(_documents(spark, sf_dir), "text", max_size=size)


def _turn_vocab(spark, sf_dir, size: int | None = None) -> DataFrame:
    return K.build_vocab(_turns(spark, sf_dir), "text", max_size=size)


def _text_columns(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({c: join_ids(F.col(c)) for c in arrays})


def _nested_text(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of arrays as text: rows divided by bars."""
    return df.withColumns(
        {c: F.array_join(F.transform(c, lambda x: join_ids(x)), "|") for c in arrays}
    )


# --- vocabulary and encoding -----------------------------------------------


@query(f"WITH {sql_vocab(DOC_TEXTS)} SELECT token, id, n FROM voc")
def vocab(spark, sf_dir):
    return _doc_vocab(spark, sf_dir)


@query(
    f"WITH {sql_vocab(DOC_TEXTS, 5000)}, {sql_encode('enc', 'documents', 'doc_id', 'text', 'ids')}"
    f" SELECT doc_id, len(list_filter(ids, lambda x: x = 1))::INTEGER AS unknown, len(ids)::INTEGER AS size FROM enc"
)
def encode_capped(spark, sf_dir):
    """A vocabulary of limited size: how much of each text it misses."""
    docs = K.encode(_documents(spark, sf_dir), "text", _doc_vocab(spark, sf_dir, 5000), "ids")
    missed = F.size(F.filter("ids", lambda x: x == F.lit(UNK_ID)))
    return docs.select("doc_id", missed.alias("unknown"), F.size("ids").alias("size"))


@query(
    """SELECT token, 1 + row_number() OVER (ORDER BY count(*) DESC, token) AS id, count(*) AS n
    FROM (SELECT unnest(string_split(text, '')) AS token FROM conversations) GROUP BY token
    UNION ALL SELECT '[PAD]', 0, 0 UNION ALL SELECT '</s>', 1, 0"""
)
def char_vocab(spark, sf_dir):
    return K.build_vocab(_turns(spark, sf_dir), "text", mode="char")


@query(
    """WITH v AS (
      SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id, count(*) AS n
      FROM (SELECT unnest(string_split(text, '')) AS token FROM conversations) GROUP BY token)
    SELECT *, '' AS roles, 2 AS added FROM v
    UNION ALL SELECT '[PAD]', (SELECT max(id) + 1 FROM v), 0, 'pad', 2
    UNION ALL SELECT '</s>', (SELECT max(id) + 2 FROM v), 0, 'bos eos unk', 2"""
)
def vocab_specials(spark, sf_dir):
    """The vocabulary with its special tokens, their roles and how many were missing."""
    plain = K.build_vocab(_turns(spark, sf_dir), "text", mode="char", roles=())
    full, ids, added = K.ensure_specials(plain)
    roles = F.array(*[F.when(F.col("id") == i, F.lit(role)) for role, i in sorted(ids.items())])
    return full.withColumns({"roles": F.array_join(roles, " "), "added": F.lit(added)})


@query(
    f"WITH {sql_vocab(DOC_TEXTS)}, {sql_encode('enc', 'documents', 'doc_id', 'text', 'ids')}"
    f" SELECT doc_id, {sql_join('ids')} AS ids FROM enc"
)
def encode(spark, sf_dir):
    docs = K.encode(_documents(spark, sf_dir), "text", _doc_vocab(spark, sf_dir), "ids")
    return _text_columns(docs.select("doc_id", "ids"), "ids")


@query(
    f"WITH {sql_vocab(DOC_TEXTS)}, {sql_encode('enc', 'documents', 'doc_id', 'text', 'ids', 128)}"
    f" SELECT doc_id, {sql_join('ids')} AS ids FROM enc"
)
def encode_truncated(spark, sf_dir):
    docs = K.encode(_documents(spark, sf_dir), "text", _doc_vocab(spark, sf_dir), "ids", max_len=128)
    return _text_columns(docs.select("doc_id", "ids"), "ids")


@query(
    "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')"
    " AS decoded FROM documents"
)
def decode(spark, sf_dir):
    """Text to ids and back with the whole vocabulary."""
    words = _doc_vocab(spark, sf_dir)
    ids = K.encode(_documents(spark, sf_dir), "text", words)
    saved = materialize(ids.select("doc_id", "input_ids"), "ids")
    back = K.decode(saved, "input_ids", words)
    return back.select("doc_id", "decoded")


@query("SELECT doc_id, text AS decoded, strlen(text) AS n_bytes FROM documents")
def subword_round_trip(spark, sf_dir):
    """Texts to ids of a pretrained vocabulary and back, and the bytes that the ids stand for."""
    vocab = W.subword_vocab(spark, RANK_FILE)
    ids = K.encode(_documents(spark, sf_dir), "text", None, tokenizer=W.subword_tokenizer(spark, RANK_FILE))
    back = W.subword_decode(materialize(ids.select("doc_id", "input_ids"), "ids"), "input_ids", vocab)
    return back.select("doc_id", "decoded", F.octet_length("decoded").cast("bigint").alias("n_bytes"))


@query(
    "SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ' ')"
    " AS ids FROM conversations"
)
def own_tokenizer(spark, sf_dir):
    """A caller's tokenizer in place of the learnt vocabulary."""
    points = token_udf(lambda text: [ord(c) for c in text])
    turns = K.encode(_turns(spark, sf_dir), "text", None, "ids", tokenizer=points)
    return _text_columns(turns.select("conv_id", "turn", "ids"), "ids")


@query("SELECT doc_id, length(text)::BIGINT AS size, upper(lang) AS lang FROM documents")
def map_batches(spark, sf_dir):
    """A caller's function on batches of rows."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "size": batch["text"].str.len(),
                "lang": batch["lang"].str.upper(),
            }
        )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return run_batches(docs, run, "doc_id long, size long, lang string")


# --- supervised labels -----------------------------------------------------

PAIR_PROMPT_SQL = sql_template(
    TRAIN_PROMPT, options_=lit(TRAIN_OPTIONS), sentence1="question"
)
SOURCES_SQL = f"""
st AS (SELECT rid, {PAIR_PROMPT_SQL} AS sources, reply || '</s>' AS targets,
  {PAIR_PROMPT_SQL} || reply || '</s>' AS whole FROM pairs)"""


def _pairs(spark, sf_dir) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir)
    return pairs.select(
        "rid",
        T.train_prompt(F.col("question")).alias("sources"),
        F.concat("reply", F.lit("</s>")).alias("targets"),
    )


@query(
    f"""WITH {PAIRS_SQL}, {SOURCES_SQL},
    {sql_vocab('SELECT whole AS text FROM st', specials=True)},
    {sql_encode('e1', 'st', 'rid', 'whole', 'ids', 128, specials=True)},
    {sql_encode('e2', 'e1', 'rid', 'sources', 'src', 128, specials=True)}
    SELECT rid, {sql_join('ids')} AS input_ids,
      {sql_join('list_transform(ids, lambda x, i: CASE WHEN i <= len(src) THEN -100 ELSE x END)')} AS labels
    FROM e2"""
)
def sft_labels(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    words = K.build_vocab(
        pairs.select(F.concat("sources", "targets").alias("text")), "text"
    )
    rows = K.sft_encode(pairs, "sources", "targets", words, 128, specials=["</s>"])
    return _text_columns(rows.select("rid", "input_ids", "labels"), "input_ids", "labels")


@query(
    f"""WITH {PAIRS_SQL}, {SOURCES_SQL},
    {sql_vocab('SELECT whole AS text FROM st', specials=True)},
    {sql_encode('e1', 'st', 'rid', 'sources', 's', None, specials=True)},
    {sql_encode('e2', 'e1', 'rid', 'targets', 't', None, specials=True)}
    SELECT rid, {sql_join('list_slice(list_concat(s, t), 1, 128)')} AS input_ids,
      {sql_join('list_slice(list_concat(list_transform(s, lambda x: -100::BIGINT), t), 1, 128)')} AS labels
    FROM e2"""
)
def sft_labels_concat(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    words = K.build_vocab(
        pairs.select(F.concat("sources", "targets").alias("text")), "text"
    )
    rows = K.sft_encode_concat(pairs, "sources", "targets", words, 128, specials=["</s>"])
    return _text_columns(rows.select("rid", "input_ids", "labels"), "input_ids", "labels")


@query(
    f"""WITH {TURNS_SQL}, {sql_vocab(TURN_TEXTS)},
    {sql_encode('enc', 'turns', 'rid', 'text', 'ids')},
    p AS (SELECT rid, {sql_pad('ids', 64, 0)} AS ids FROM enc)
    SELECT rid, {sql_join('ids')} AS input_ids, {sql_join(sql_mask('ids'))} AS attention_mask FROM p"""
)
def pad_mask(spark, sf_dir):
    turns = K.encode(_turns(spark, sf_dir), "text", _turn_vocab(spark, sf_dir))
    padded = P.pad_columns(turns.select("rid", "input_ids"), {"input_ids": 0}, 64)
    padded = padded.withColumn("attention_mask", attention_mask(F.col("input_ids"), 0))
    return _text_columns(padded, "input_ids", "attention_mask")


# --- packing ---------------------------------------------------------------


def sql_blocks(source: str, block: int, batch_rows: int, keep_short: bool, split: str = "") -> str:
    """CTE ``blocks`` over (doc_id, ids[, split]) rows."""
    part = f"{split}, " if split else ""
    over = f"PARTITION BY {split}" if split else ""
    short = f"total_ < {block} OR " if keep_short else ""
    return f"""
bat_ AS (
  SELECT {part} doc_id, ids, (row_number() OVER ({over} ORDER BY doc_id) - 1) // {batch_rows} AS batch
  FROM {source}),
flat_ AS (SELECT {part} batch, doc_id, unnest(ids) AS id_, generate_subscripts(ids, 1) AS p_ FROM bat_),
num_ AS (
  SELECT *, row_number() OVER (PARTITION BY {part} batch ORDER BY doc_id, p_) - 1 AS o_,
    count(*) OVER (PARTITION BY {part} batch) AS total_
  FROM flat_),
blocks AS (
  SELECT {part} batch, o_ // {block} AS block, string_agg(id_::VARCHAR, ' ' ORDER BY o_) AS input_ids
  FROM num_ WHERE {short} o_ < total_ // {block} * {block} GROUP BY ALL)"""


def sql_buffers(source: str, block: int, budget: str) -> str:
    """CTE ``blocks`` over (split, doc_id, chars, ids): each buffer starts where the last one closed."""
    return f"""
before_ AS (
  SELECT split, doc_id, ids, (sum(chars) OVER (PARTITION BY split ORDER BY doc_id) - chars)::BIGINT AS c_
  FROM {source}),
starts_(split, c_) AS (
  SELECT DISTINCT split, 0::BIGINT FROM before_
  UNION ALL
  SELECT s.split, min(b.c_) FROM starts_ s JOIN before_ b ON b.split = s.split AND b.c_ >= s.c_ + {budget}
  GROUP BY s.split, s.c_),
numbered_ AS (SELECT split, c_, row_number() OVER (PARTITION BY split ORDER BY c_) - 1 AS buffer FROM starts_),
held_ AS (SELECT b.split, b.doc_id, b.ids, n.buffer FROM before_ b ASOF JOIN numbered_ n ON b.split = n.split AND b.c_ >= n.c_),
flat_ AS (SELECT split, buffer, doc_id, unnest(ids) AS id_, generate_subscripts(ids, 1) AS p_ FROM held_),
num_ AS (
  SELECT *, row_number() OVER (PARTITION BY split, buffer ORDER BY doc_id, p_) - 1 AS o_,
    count(*) OVER (PARTITION BY split, buffer) AS total_ FROM flat_),
blocks AS (
  SELECT split, buffer, o_ // {block} AS block, string_agg(id_::VARCHAR, ' ' ORDER BY o_) AS input_ids
  FROM num_ WHERE o_ < total_ // {block} * {block} GROUP BY ALL)"""


@query(
    f"WITH {sql_vocab(DOC_TEXTS)}, {sql_encode('enc', 'documents', 'doc_id', 'text', 'ids')},"
    f" {sql_blocks('enc', 64, 100, True)} SELECT batch, block, input_ids FROM blocks"
)
def pack_blocks(spark, sf_dir):
    ids = K.encode(_documents(spark, sf_dir), "text", _doc_vocab(spark, sf_dir))
    packed = P.pack_blocks(ids.select("doc_id", "input_ids"), "input_ids", 64, "doc_id", 100)
    return _text_columns(packed.select("batch", "block", "input_ids"), "input_ids")


@query(
    f"""WITH {sql_vocab(DOC_TEXTS)}, {sql_encode('enc', 'documents', 'doc_id', 'text', 'ids')},
    {sql_blocks('enc', 62, 100, True)} SELECT batch, block, '101 ' || input_ids || ' 102' AS input_ids FROM blocks"""
)
def pack_wrapped(spark, sf_dir):
    ids = K.encode(_documents(spark, sf_dir), "text", _doc_vocab(spark, sf_dir), bos_id=101, eos_id=102)
    packed = P.pack_wrapped(ids.select("doc_id", "input_ids"), "input_ids", 64, "doc_id", 100)
    return _text_columns(packed, "input_ids")


@query(
    f"""WITH {sql_vocab(DOC_TEXTS)}, {sql_encode('e0', 'documents', 'doc_id', 'text', 'raw')},
    enc AS (SELECT doc_id, list_append(raw, 1) AS ids FROM e0),
    {sql_blocks('enc', 64, 100, False)} SELECT batch, block, input_ids FROM blocks"""
)
def pack_constant(spark, sf_dir):
    ids = K.encode(_documents(spark, sf_dir), "text", _doc_vocab(spark, sf_dir))
    packed = P.pack_constant(
        ids.select("doc_id", "input_ids"), "input_ids", 64, EOS_ID, "doc_id", 100
    )
    return _text_columns(packed.select("batch", "block", "input_ids"), "input_ids")


# --- batches ---------------------------------------------------------------


@query(
    """WITH r AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents)
    SELECT batch, count(*)::INTEGER AS n_rows, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS doc_ids,
      string_agg(n_chars::VARCHAR, ' ' ORDER BY doc_id) AS sizes FROM r GROUP BY batch"""
)
def batch_assembly(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    batches = P.assemble_batches(docs, ["doc_id", "n_chars"], 32, "doc_id")
    return _text_columns(batches, "doc_id", "n_chars").withColumnsRenamed(
        {"doc_id": "doc_ids", "n_chars": "sizes"}
    )


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql_shuffle(7, 'event_id')}, event_id) - 1 AS p FROM events)
    SELECT p // 64 AS batch, count(*)::INTEGER AS n_rows, string_agg(event_id::VARCHAR, ' ' ORDER BY p) AS event_ids
    FROM r GROUP BY ALL"""
)
def batch_shuffled(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    batches = P.assemble_batches(events, ["event_id"], 64, "event_id", shuffle_seed=7)
    return _text_columns(batches, "event_id").withColumnRenamed("event_id", "event_ids")


TURN_BATCHES_SQL = f"""
{TURNS_SQL}, {sql_vocab(TURN_TEXTS)},
{sql_encode('enc', 'turns', 'rid', 'text', 'ids')},
bat AS (
  SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch FROM enc),
siz AS (
  SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS long_, min(len(ids)) OVER (PARTITION BY batch) AS short_,
    first_value(ids) OVER (PARTITION BY batch ORDER BY conv_id, turn) AS first_ FROM bat)"""


def _turn_batches(spark, sf_dir) -> DataFrame:
    turns = K.encode(_turns(spark, sf_dir), "text", _turn_vocab(spark, sf_dir))
    turns = turns.select("conv_id", "turn", "input_ids", F.col("turn").alias("label"))
    return P.assemble_batches(turns, ["input_ids", "label"], 8, ["conv_id", "turn"])


@query(
    f"""WITH {TURN_BATCHES_SQL}
    SELECT batch, string_agg({sql_join(sql_pad('ids', 'long_', 0))}, '|' ORDER BY conv_id, turn) AS input_ids,
      string_agg({sql_join(sql_mask(sql_pad('ids', 'long_', 0)))}, '|' ORDER BY conv_id, turn) AS attention_mask
    FROM siz GROUP BY batch"""
)
def pad_longest(spark, sf_dir):
    batches = P.pad_batches(_turn_batches(spark, sf_dir), {"input_ids": 0}, mask_of="input_ids")
    return _nested_text(
        batches.select("batch", "input_ids", "attention_mask"), "input_ids", "attention_mask"
    )


@query(
    f"""WITH {TURN_BATCHES_SQL}
    SELECT batch, count(*)::INTEGER AS n_rows, max(CASE WHEN long_ <> short_ THEN 1 ELSE 0 END)::INTEGER AS ragged,
      string_agg({sql_join('CASE WHEN long_ <> short_ THEN first_ ELSE ids END')}, '|' ORDER BY conv_id, turn) AS input_ids,
      string_agg(turn::VARCHAR, ' ' ORDER BY conv_id, turn) AS labels
    FROM siz GROUP BY batch"""
)
def batch_ragged(spark, sf_dir):
    batches = P.collate_ragged(_turn_batches(spark, sf_dir), "repeat_first")
    rows = _text_columns(_nested_text(batches, "input_ids"), "labels")
    return rows.withColumn("ragged", F.col("ragged").cast("int"))


@query(
    f"""WITH {TURN_BATCHES_SQL}
    SELECT batch, count(*)::INTEGER AS n_rows, max(CASE WHEN long_ <> short_ THEN 1 ELSE 0 END)::INTEGER AS ragged,
      string_agg({sql_join(sql_pad('ids', 'long_', 0))}, '|' ORDER BY conv_id, turn) AS input_ids,
      string_agg(turn::VARCHAR, ' ' ORDER BY conv_id, turn) AS labels
    FROM siz GROUP BY batch"""
)
def batch_padded(spark, sf_dir):
    """Ragged batches under the default rule."""
    rows = _text_columns(_nested_text(P.collate_ragged(_turn_batches(spark, sf_dir)), "input_ids"), "labels")
    return rows.withColumn("ragged", F.col("ragged").cast("int"))


# --- training rows ---------------------------------------------------------

SPLIT_LABELLED_SQL = f"{LABELLED_SQL}, {sql_split('sp', 'labelled')}"


def _split_labelled(spark, sf_dir) -> DataFrame:
    return split_exact(labelled(spark, sf_dir).select("doc_id", "text", "quality"), "doc_id")


@query(
    f"""WITH {SPLIT_LABELLED_SQL}, {sql_vocab('SELECT text FROM labelled')},
    {sql_encode('enc', 'sp', 'doc_id', 'text', 'ids', 128)},
    r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM enc)
    SELECT doc_id, split, {sql_join('ids')} AS input_ids, {sql_join(sql_mask('ids'))} AS attention_mask,
      quality AS labels FROM r WHERE split = 'train' OR rn <= 20"""
)
def classifier_rows(spark, sf_dir):
    rows = _split_labelled(spark, sf_dir)
    words = K.build_vocab(rows, "text")
    data = T.classifier_data(
        rows, "text", "quality", "doc_id", words, 128, {"validation": 20, "test": 20}
    )
    return _text_columns(data, "input_ids", "attention_mask")


@query(
    f"""WITH {SPLIT_LABELLED_SQL}, {sql_vocab('SELECT text FROM labelled')},
    {sql_encode('enc', 'sp', 'doc_id', 'text', 'ids', 256)},
    p AS (SELECT * REPLACE ({sql_pad('ids', 256, 0)} AS ids) FROM enc)
    SELECT doc_id, split, {sql_join('ids')} AS input_ids, {sql_join(sql_mask('ids'))} AS attention_mask,
      quality AS labels FROM p"""
)
def long_classifier_rows(spark, sf_dir):
    """Text labels are coded and every row is padded to the model's length."""
    rows = decode_label(_split_labelled(spark, sf_dir), LABEL_TO_TARGET, "quality", "target")
    words = K.build_vocab(rows, "text")
    data = T.classifier_data(
        rows, "text", "target", "doc_id", words, 256, label_mapping=TARGET_TO_LABEL, pad_to=256
    )
    return _text_columns(data, "input_ids", "attention_mask")


@query(
    f"""WITH {SPLIT_LABELLED_SQL},
    st AS (SELECT doc_id, split, {PROMPT_SQL} AS sources, {PROMPT_SQL} || quality || '</s>' AS whole FROM sp),
    {sql_vocab('SELECT text FROM labelled')},
    {sql_encode('e1', 'st', 'doc_id', 'whole', 'ids', 256, specials=True)},
    {sql_encode('e2', 'e1', 'doc_id', 'sources', 'src', 256, specials=True)}
    SELECT doc_id, split, {sql_join('ids')} AS input_ids,
      {sql_join('list_transform(ids, lambda x, i: CASE WHEN i <= len(src) THEN -100 ELSE x END)')} AS labels
    FROM e2"""
)
def sft_rows(spark, sf_dir):
    rows = _split_labelled(spark, sf_dir)
    words = K.build_vocab(rows, "text")
    data = T.sft_data(rows, "text", "quality", "doc_id", words, 256)
    return _text_columns(data, "input_ids", "labels")


@query(
    f"""WITH {LABELLED_SQL},
    st AS (SELECT doc_id, {PROMPT_SQL} AS sources, {PROMPT_SQL} || quality || '</s>' AS whole FROM labelled),
    {sql_vocab('SELECT text FROM labelled')},
    {sql_encode('e1', 'st', 'doc_id', 'whole', 'ids', 256, specials=True)},
    {sql_encode('e2', 'e1', 'doc_id', 'sources', 'src', 256, specials=True)},
    lab AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch,
      list_transform(ids, lambda x, i: CASE WHEN i <= len(src) THEN -100 ELSE x END) AS lab FROM e2),
    siz AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS long_ FROM lab)
    SELECT batch, string_agg({sql_join(sql_pad('ids', 'long_', 0))}, '|' ORDER BY doc_id) AS input_ids,
      string_agg({sql_join(sql_pad('lab', 'long_', -100))}, '|' ORDER BY doc_id) AS labels,
      string_agg({sql_join(sql_mask(sql_pad('ids', 'long_', 0)))}, '|' ORDER BY doc_id) AS attention_mask
    FROM siz GROUP BY batch"""
)
def sft_batches(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "text", "quality", F.lit("train").alias("split"))
    words = K.build_vocab(rows, "text")
    data = T.sft_data(rows, "text", "quality", "doc_id", words, 256)
    batches = T.sft_batches(data, "doc_id", 4).drop("n_rows")
    return _nested_text(batches, "input_ids", "labels", "attention_mask")


@query(
    f"""WITH {sql_split('sp', 'documents')}, {sql_vocab(DOC_TEXTS)},
    {sql_encode('enc', 'sp', 'doc_id', 'text', 'ids')}, {sql_blocks('enc', 128, 100, True, 'split')}
    SELECT split, batch, block, input_ids, input_ids AS labels FROM blocks"""
)
def pretrain_rows(spark, sf_dir):
    rows = split_exact(_documents(spark, sf_dir), "doc_id")
    data = T.pretrain_data(
        rows, "text", "doc_id", _doc_vocab(spark, sf_dir), 128, batch_rows=100
    )
    return _text_columns(data, "input_ids", "labels")


@query(
    f"""WITH RECURSIVE {sql_split('sp', 'documents')}, {sql_vocab(DOC_TEXTS)},
    pr AS (SELECT doc_id, split, {PROMPT_SQL} AS prompt FROM sp WHERE split <> 'test'),
    {sql_encode('e0', 'pr', 'doc_id', 'prompt', 'raw')},
    enc AS (SELECT doc_id, split, length(prompt) AS chars, list_append(raw, 1) AS ids FROM e0),
    rat AS (SELECT sum(length(prompt))::DOUBLE / sum(len({sql_words('prompt')})) AS ratio
      FROM (SELECT prompt FROM pr WHERE split = 'train' ORDER BY doc_id LIMIT 400)),
    {sql_buffers('enc', 128, '(SELECT ceil(128 * ratio * 8)::BIGINT FROM rat)')}
    SELECT split, buffer, block, input_ids, (SELECT round(ratio, 6) FROM rat) AS ratio FROM blocks"""
)
def constant_length_rows(spark, sf_dir):
    """Buffers of 8 sequences, so that even a small table closes many."""
    rows = split_exact(_documents(spark, sf_dir), "doc_id")
    data, ratio = T.constant_length_data(rows, "text", "doc_id", _doc_vocab(spark, sf_dir), 128, sequences=8)
    blocks = data.drop("labels").withColumn("ratio", ratio.select(F.round("ratio", 6)).scalar())
    return _text_columns(blocks, "input_ids")


@query(
    f"""WITH {sql_vocab(DOC_TEXTS)},
    pr AS (SELECT doc_id, {PROMPT_SQL} AS prompt FROM documents),
    {sql_encode('enc', 'pr', 'doc_id', 'prompt', 'ids', 128)},
    p AS (SELECT doc_id, {sql_pad('ids', 128, 0)} AS ids FROM enc)
    SELECT doc_id, {sql_join('ids')} AS input_ids, {sql_join(sql_mask('ids'))} AS attention_mask FROM p"""
)
def preference_rows(spark, sf_dir):
    data = T.preference_data(
        _documents(spark, sf_dir), "text", "doc_id", _doc_vocab(spark, sf_dir), 128
    )
    return _text_columns(data, "input_ids", "attention_mask")


SEQ2SEQ_SQL = sql_template(
    SEQ2SEQ_PROMPT, options_=lit(SEQ2SEQ_OPTIONS), sentence1="question"
)


@query(
    f"""WITH {PAIRS_SQL}, {sql_vocab(TURN_TEXTS)},
    st AS (SELECT rid, {SEQ2SEQ_SQL} AS prompt, reply FROM pairs),
    {sql_encode('e1', 'st', 'rid', 'prompt', 'ids', 128)},
    {sql_encode('e2', 'e1', 'rid', 'reply', 'lab', 128)},
    p AS (SELECT rid, {sql_pad('ids', 128, 0)} AS ids, {sql_pad('lab', 128, 0)} AS lab FROM e2)
    SELECT rid, {sql_join('ids')} AS input_ids, {sql_join(sql_mask('ids'))} AS attention_mask,
      {sql_join('lab')} AS labels FROM p"""
)
def seq2seq_rows(spark, sf_dir):
    data = T.seq2seq_data(
        turn_pairs(spark, sf_dir), "question", "reply", ["rid"], _turn_vocab(spark, sf_dir), 128
    )
    return _text_columns(data, "input_ids", "attention_mask", "labels")


# --- token statistics ------------------------------------------------------


@query(
    f"""WITH pr AS (SELECT doc_id, {PROMPT_SQL} AS prompt FROM documents ORDER BY doc_id LIMIT 400),
    s AS (SELECT length(prompt) AS c, len(list_filter(string_split_regex(prompt, '\\s+'), lambda x: x <> '')) AS t FROM pr)
    SELECT sum(c)::BIGINT AS characters, sum(t)::BIGINT AS tokens, round(sum(c)::DOUBLE / sum(t), 6) AS ratio FROM s"""
)
def chars_per_token(spark, sf_dir):
    prompts = table(spark, sf_dir, "documents").select(
        "doc_id", T.train_prompt(F.col("text")).alias("prompt")
    )
    first = head_n(prompts, RATIO_EXAMPLES, "doc_id")
    ratio = M.ratio_of(K.encode(first, "prompt", _doc_vocab(spark, sf_dir)), "prompt", "input_ids")
    return ratio.withColumn("ratio", F.round("ratio", 6))


@query(
    """WITH s AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
    m AS (SELECT count(*)::DOUBLE AS "rows", min(n)::DOUBLE AS "min", avg(n) AS "mean", max(n)::DOUBLE AS "max",
      quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.99)::DOUBLE AS p99 FROM s)
    SELECT metric, round(value, 6) AS value
    FROM (UNPIVOT m ON "rows", "min", "mean", "max", p50, p90, p99 INTO NAME metric VALUE value)"""
)
def seq_len_stats(spark, sf_dir):
    """Lengths by the tokeniser alone: ids are not needed to count them."""
    cut = _documents(spark, sf_dir).select(tokens(F.col("text"), "word", K.special_names()).alias("tokens"))
    return M.length_report(cut, "tokens").withColumn("value", F.round("value", 6))
