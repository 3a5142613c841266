"""Vocabulary, encoding and supervised labels.

A lookup is narrow: the frequent part of the vocabulary, whose size is bounded
in entries and bytes, becomes one array of small maps that every task probes
inside the projection. Only tokens outside that part are joined, whatever the
size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.constants import IGNORE_INDEX, PAD_ID, SPECIAL_TOKENS, UNK_ID
from corpus_spark.functions.arrays import mask_prefix
from corpus_spark.functions.text import tokens
from corpus_spark.operators.order import NARROW_BUCKET_ROWS, positions
from corpus_spark.session import materialize

__all__ = [
    "build_vocab",
    "ensure_specials",
    "encode",
    "decode",
    "lookup_list",
    "sft_encode",
    "sft_encode_concat",
    "special_names",
]

HEAD_ENTRIES = 262_144
HEAD_BYTES = 64
LOOKUP_SLOTS = 65_536


def special_names(roles: Sequence[tuple[str, str]] = SPECIAL_TOKENS) -> list[str]:
    """Distinct special tokens in the order they get ids."""
    return list(dict.fromkeys(token for _, token in roles))


def build_vocab(
    df: DataFrame,
    column: str,
    mode: str = "word",
    min_count: int = 1,
    max_size: int | None = None,
    roles: Sequence[tuple[str, str]] = SPECIAL_TOKENS,
) -> DataFrame:
    """Learn (token, id, n): specials first, then by falling count and token.

    Counting combines equal tokens before they move. The table is written once.
    """
    specials = special_names(roles)
    counts = (
        df.select(F.explode(tokens(F.col(column), mode, specials)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") >= min_count) & ~F.col("token").isin(specials))
    )
    counts = materialize(counts, "token-counts")
    room = None if max_size is None else max(max_size - len(specials), 0)
    if room is not None:
        counts = _frequent(counts, room)
    learnt = positions(counts, [-F.col("n"), F.col("token")], name="id", bucket_rows=NARROW_BUCKET_ROWS, written=True)
    if room is not None:
        learnt = learnt.where(F.col("id") < room)
    learnt = learnt.select("token", (F.col("id") + len(specials)).alias("id"), "n")
    fixed = df.sparkSession.createDataFrame(
        [(token, i, 0) for i, token in enumerate(specials)], "token string, id bigint, n bigint"
    )
    return materialize(fixed.unionByName(learnt), "vocabulary")


def _frequent(counts: DataFrame, room: int) -> DataFrame:
    """Drop the rare tokens that cannot be among the first ``room``.

    One count per power of two of the frequency, at most 64 rows, gives a lower
    bound of the frequency; ties and order are settled afterwards.
    """
    octave = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = counts.groupBy(octave.alias("octave")).agg(F.count("*").alias("size")).collect()
    total, lowest = 0, 0
    for row in sorted(sizes, reverse=True):
        total, lowest = total + row["size"], row["octave"]
        if total >= room:
            break
    return counts.where(octave >= lowest)


def ensure_specials(
    vocab: DataFrame,
    roles: Sequence[tuple[str, str]] = SPECIAL_TOKENS,
    configured: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, int], int]:
    """Add the special tokens that are missing, after the highest id.

    Roles in ``configured`` already have a token and are left alone. Returns the
    vocabulary, the id of every other role and the number of tokens added.
    """
    wanted = [(role, token) for role, token in roles if role not in set(configured)]
    names = special_names(wanted)
    ids = {r[0]: r[1] for r in vocab.where(F.col("token").isin(names)).select("token", "id").collect()}
    following = (vocab.agg(F.max("id")).first()[0] or 0) + 1 if not vocab.isEmpty() else 0
    missing = [name for name in names if name not in ids]
    ids.update({name: following + i for i, name in enumerate(missing)})
    if missing:
        rows = [(name, ids[name], 0) for name in missing]
        added = vocab.sparkSession.createDataFrame(rows, "token string, id bigint, n bigint")
        vocab = vocab.unionByName(added.select(*vocab.columns))
    return vocab, {role: ids[token] for role, token in wanted}, len(missing)


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _head_lookup(head: DataFrame, key: str, value: str, slots: int) -> Column:
    """One array of small maps, addressed by the hash of the key."""
    entry = F.struct(F.col(key), F.col(value))
    filled = head.groupBy(_slot(F.col(key), slots).alias("slot")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("entries")
    )
    every = head.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    ordered = F.array_sort(
        F.collect_list(F.struct("slot", "entries")), lambda a, b: a["slot"] - b["slot"]
    )
    return (
        every.join(filled, "slot", "left")
        .agg(F.transform(ordered, lambda e: e["entries"]).alias("lookup"))
        .scalar()
    )


def lookup_list(
    df: DataFrame,
    items: Column,
    table: DataFrame,
    key: str,
    value: str,
    out: str,
    default: Column,
    head_entries: int | None = None,
    spent: Sequence[str] = (),
) -> DataFrame:
    """Replace every item of an array through a (key, value) table with dense ids.

    Items outside the head of the table are joined and put back by position. For that
    the probed rows are written once, with a number of their own: the texts are read
    and cut once, and rows may repeat. Rows without such items are not moved. Columns
    named in ``spent`` only serve ``items``: they are neither written nor returned.
    """
    head_entries = head_entries or HEAD_ENTRIES
    in_head = F.col("id") < head_entries
    for text in (key, value):
        if table.schema[text].dataType.simpleString() == "string":
            in_head = in_head & (F.octet_length(text) <= HEAD_BYTES)
    tail, head = table.where(~in_head), table.where(in_head)
    slots = max(64, min(LOOKUP_SLOTS, head.count() // 4))
    mapped = df.withColumn("_lookup", _head_lookup(head, key, value, slots))

    # One expression uses the lookup and nothing passes it on, so that it is inlined: as a
    # column of a projection the whole lookup would be copied into every row.
    def probe(item: Column) -> Column:
        return F.try_element_at(F.get(F.col("_lookup"), _slot(item, slots)), item)

    if tail.isEmpty():
        found = F.transform(items, lambda x: F.coalesce(probe(x), default))
        return mapped.withColumn(out, found).drop("_lookup", *spent)

    probed = F.transform(items, lambda x: F.struct(x.alias("item"), probe(x).alias("hit")))
    mapped = mapped.withColumn("_probed", probed).drop("_lookup", *spent)
    absent = F.transform(
        "_probed", lambda r, i: F.when(r["hit"].isNull(), F.struct(i.alias("pos"), r["item"].alias("item")))
    )
    mapped = mapped.withColumns(
        {
            "_found": F.col("_probed.hit"),
            "_row": F.monotonically_increasing_id(),
            "_missed": F.filter(absent, lambda r: r.isNotNull()),
        }
    )
    written = materialize(mapped.drop("_probed"), "probed")
    whole = F.coalesce(F.size("_missed"), F.lit(0)) == 0

    # Too large to broadcast, whatever an estimate says: merge join. A frequent item that
    # the table lacks makes a large partition, which adaptive execution splits.
    misses = written.where(~whole).select("_row", F.explode("_missed").alias("miss")).select("_row", "miss.*")
    rest = tail.select(F.col(key).alias("item"), F.col(value).alias("late"))
    late = (
        misses.join(rest.hint("merge"), "item", "left")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("pos", F.coalesce("late", default).alias("hit"))).alias("_late"))
    )
    known = F.filter(
        F.transform("_found", lambda x, i: F.struct(i.alias("pos"), x.alias("hit"))),
        lambda r: r["hit"].isNotNull(),
    )
    merged = F.transform(F.sort_array(F.concat(known, F.col("_late"))), lambda r: r["hit"])
    columns = [c for c in df.columns if c != out and c not in spent]
    complete = written.where(whole).select(*columns, F.col("_found").alias(out))
    mended = written.where(~whole).drop("_missed").join(late, "_row").select(*columns, merged.alias(out))
    return complete.unionByName(mended)


def _cut(items: Column, max_len: int | None, bos_id: int | None = None, eos_id: int | None = None) -> Column:
    """What ``max_len`` leaves of a text's tokens or ids, beside its special ids."""
    if max_len is None:
        return items
    room = max(max_len - (bos_id is not None) - (eos_id is not None), 0)
    return F.slice(items, 1, room)


def _wrap_and_cut(
    ids: Column, max_len: int | None, bos_id: int | None, eos_id: int | None
) -> Column:
    extra = [F.array(F.lit(i).cast("bigint")) if i is not None else None for i in (bos_id, eos_id)]
    ids = _cut(ids, max_len, bos_id, eos_id)
    parts = [p for p in (extra[0], ids, extra[1]) if p is not None]
    return F.concat(*parts) if len(parts) > 1 else ids


def encode(
    df: DataFrame,
    column: str,
    vocab: DataFrame | None,
    out: str = "input_ids",
    mode: str = "word",
    max_len: int | None = None,
    unk_id: int = UNK_ID,
    bos_id: int | None = None,
    eos_id: int | None = None,
    specials: Sequence[str] | None = None,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add the token ids of a text column, optionally cut to ``max_len``.

    The text is cut up as ``build_vocab`` does it, with the same special tokens by default.
    ``tokenizer`` (see ``token_udf``) replaces the learnt vocabulary. Tokens that ``max_len``
    cuts off are not looked up.
    """
    if tokenizer is not None:
        df = df.withColumn(out, tokenizer(F.col(column)).cast("array<bigint>"))
    else:
        words = tokens(F.col(column), mode, special_names() if specials is None else specials)
        words = _cut(words, max_len, bos_id, eos_id)
        unknown = F.lit(unk_id).cast("bigint")
        df = lookup_list(df, words, vocab, "token", "id", out, unknown)
    return df.withColumn(out, _wrap_and_cut(F.col(out), max_len, bos_id, eos_id))


def decode(
    df: DataFrame,
    ids: str,
    vocab: DataFrame,
    out: str = "tokens",
    joined: str | None = "decoded",
    mode: str = "word",
    skip_ids: Sequence[int] = (),
    unk_token: str = "</s>",
) -> DataFrame:
    """Add the tokens of an id column and, unless ``joined`` is None, their text."""
    source = F.transform(F.col(ids), lambda x: x.cast("bigint"))
    if skip_ids:
        source = F.filter(source, lambda x: ~x.isin(list(skip_ids)))
    df = lookup_list(df, source, vocab, "id", "token", out, F.lit(unk_token))
    if joined is None:
        return df
    return df.withColumn(joined, F.array_join(out, "" if mode == "char" else " "))


def _encode_columns(
    df: DataFrame,
    texts: Mapping[str, Column],
    vocab: DataFrame | None,
    mode: str = "word",
    unk_id: int = UNK_ID,
    specials: Sequence[str] | None = None,
    tokenizer: Callable[[Column], Column] | None = None,
    cut: Callable[[Column], Column] = lambda items: items,
) -> DataFrame:
    """Add the ids of several texts through one lookup of all their tokens, cut apart again by size.

    ``cut`` drops tokens whose ids the caller would drop anyway.
    """
    if tokenizer is not None:
        return df.withColumns({out: tokenizer(text).cast("array<bigint>") for out, text in texts.items()})
    names = special_names() if specials is None else specials
    df = df.withColumn("_lists", F.array(*[cut(tokens(text, mode, names)) for text in texts.values()]))
    df = df.withColumn("_sizes", F.transform("_lists", lambda x: F.when(x.isNotNull(), F.size(x))))
    items = F.flatten(F.transform("_lists", lambda x: F.coalesce(x, F.array().cast("array<string>"))))
    df = lookup_list(df, items, vocab, "token", "id", "_ids", F.lit(unk_id).cast("bigint"), spent=["_lists"])
    start, parts = F.lit(1), {}
    for i, out in enumerate(texts):
        size = F.get("_sizes", F.lit(i))
        parts[out] = F.slice("_ids", start, size)
        start = start + F.coalesce(size, F.lit(0))
    return df.withColumns(parts).drop("_ids", "_sizes")


def sft_encode(
    df: DataFrame,
    source: str,
    target: str,
    vocab: DataFrame | None,
    max_len: int,
    pad_id: int = PAD_ID,
    bos_id: int | None = None,
    eos_id: int | None = None,
    **options: object,
) -> DataFrame:
    """Encode source and target as one text; labels hide the source.

    The hidden length is that of the source encoded alone, as both are cut at
    ``max_len``; pad ids do not count.
    """
    full = F.concat(F.col(source), F.col(target))
    texts = {"input_ids": full, "_source_ids": F.col(source)}
    df = _encode_columns(df, texts, vocab, cut=lambda items: _cut(items, max_len, bos_id, eos_id), **options)
    for out in ("input_ids", "_source_ids"):
        df = df.withColumn(out, _wrap_and_cut(F.col(out), max_len, bos_id, eos_id))
    length = F.size(F.filter("_source_ids", lambda x: x != F.lit(pad_id)))
    labels = mask_prefix(F.col("input_ids"), length, IGNORE_INDEX)
    return df.withColumn("labels", labels).drop("_source_ids")


def sft_encode_concat(
    df: DataFrame,
    source: str,
    target: str,
    vocab: DataFrame | None,
    max_len: int,
    bos_id: int | None = None,
    eos_id: int | None = None,
    **options: object,
) -> DataFrame:
    """Encode source and target apart, the target without special ids, and join the ids."""
    texts = {"_s": F.col(source), "_t": F.col(target)}
    df = _encode_columns(df, texts, vocab, cut=lambda items: _cut(items, max_len), **options)
    df = df.withColumn("_s", _wrap_and_cut(F.col("_s"), None, bos_id, eos_id))
    hidden = F.array_repeat(F.lit(IGNORE_INDEX).cast("bigint"), F.size("_s"))
    return df.withColumns(
        {
            "input_ids": F.slice(F.concat("_s", "_t"), 1, max_len),
            "labels": F.slice(F.concat(hidden, F.col("_t")), 1, max_len),
        }
    ).drop("_s", "_t")
