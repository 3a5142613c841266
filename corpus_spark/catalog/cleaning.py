"""Queries: columns, text, order, splits and cleaning plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.catalog.registry import (
    DOC_SEPARATORS,
    LABELLED_SQL,
    PAIRS_SQL,
    lit,
    query,
    sql_repack,
    sql_shuffle,
    sql_split,
    sql_template,
    sql_words,
    table,
    turn_pairs,
    labelled,
)
from corpus_spark.constants import (
    ANSWER_MARKER,
    INFERENCE_NO_INPUT,
    INFERENCE_PROMPT,
    INFERENCE_WITH_INPUT,
    INSTRUCTION_TEMPLATE,
    LABEL_TO_TARGET,
    PIPE_SEPARATOR,
    PIPE_SOURCE,
    PROMPT_INSTRUCTION,
    PROMPT_OUTPUTS,
    SEPARATORS,
    SEQ2SEQ_OPTIONS,
    SUMMARY_PROMPT,
    TARGET_TO_LABEL,
    TRAIN_OPTIONS,
    TRAIN_PROMPT,
)
from corpus_spark.functions import (
    array_intersection,
    chunk_array,
    extract_answer,
    fill_template,
    text_length,
    text_size as count_words,
    words,
)
from corpus_spark.operators import order as O
from corpus_spark.operators import schema as S
from corpus_spark.plans.clean import clean_two_sources, merge_and_split, prompt_merge_and_split
from corpus_spark.plans.training import (
    instruction_pairs as build_instruction_pairs,
    request_prompt,
    source_target_pairs,
    train_prompt,
)
from corpus_spark.session import scratch_path
from corpus_spark.streaming.clean import clean_step, clean_stream

CASE_VALUES = ("plain", "empty", "long", "mixed script")


def _by_language(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return [
        docs.where("lang <> 'en'").drop("lang"),
        docs.where("lang = 'en'").drop("lang"),
    ]


# --- columns ---------------------------------------------------------------


@query("SELECT page_id, html AS text, 2 AS labels FROM pages")
def column_roles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return S.canonical_columns(pages, 2, ["0", "url", "html", "content"], keep=["page_id"])


@query("SELECT doc_id, text, quality AS labels FROM documents JOIN labels USING (doc_id)")
def label_role(spark, sf_dir):
    return S.canonical_columns(
        labelled(spark, sf_dir), 0, label_candidates=["toxic", "quality"], keep=["doc_id"]
    )


@query("SELECT doc_id AS input_ids, quality AS labels FROM labels")
def keep_columns(spark, sf_dir):
    renamed = table(spark, sf_dir, "labels").withColumnsRenamed(
        {"doc_id": "input_ids", "quality": "labels"}
    )
    return S.keep_columns(renamed)


@query(f"SELECT text, {lit('ai写的')} AS target FROM benchmark")
def add_constant(spark, sf_dir):
    return S.add_constant(table(spark, sf_dir, "benchmark"), "target", "ai写的", ["item_id"])


@query(
    f"SELECT doc_id, CASE quality WHEN 0 THEN {lit('ai写的')} WHEN 1 THEN {lit('人类写的')} END AS target,"
    " quality AS labels, toxic FROM labels"
)
def label_codes(spark, sf_dir):
    """Integer to text and back."""
    named = S.decode_label(table(spark, sf_dir, "labels"), LABEL_TO_TARGET, "quality", "target")
    coded = S.encode_label(named.withColumn("t", F.col("target")), TARGET_TO_LABEL, "t", "labels")
    return coded.drop("quality")


@query("SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang")
def label_unknown(spark, sf_dir):
    return S.unknown_labels(table(spark, sf_dir, "documents"), {"en": 0, "fr": 1}, "lang")


@query(
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, array_to_string(list_filter({sql_words('question')},"
    f" lambda w: list_contains({sql_words('reply')}, w)), ' ') AS common FROM pairs"
)
def list_intersection(spark, sf_dir):
    common = array_intersection(words(F.col("question")), words(F.col("reply")))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(common, " ").alias("common"))


@query(
    "SELECT 0 AS source, doc_id AS id, text FROM documents"
    " UNION ALL SELECT 1, item_id, text FROM benchmark"
    " UNION ALL SELECT 2, page_id, html FROM pages"
)
def union_sources(spark, sf_dir):
    names = [("documents", "doc_id", "text"), ("benchmark", "item_id", "text"), ("pages", "page_id", "html")]
    return S.union_sources(
        [
            table(spark, sf_dir, name).select(
                F.lit(i).alias("source"), F.col(key).alias("id"), F.col(text).alias("text")
            )
            for i, (name, key, text) in enumerate(names)
        ]
    )


@query(
    "SELECT doc_id, lang || '输入' || v AS case FROM documents,"
    f" (SELECT unnest([{', '.join(lit(v) for v in CASE_VALUES)}]) AS v)"
)
def cross_cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.cross_cases(docs, "lang", CASE_VALUES).drop("lang")


# --- text ------------------------------------------------------------------


@query(f"SELECT doc_id, len({sql_words('text')})::INTEGER AS text_size, length(text)::INTEGER AS text_length FROM documents")
def text_size(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", count_words(t).alias("text_size"), text_length(t).alias("text_length")
    )


@query(
    f"WITH {LABELLED_SQL} SELECT doc_id, text AS input, {lit(PROMPT_INSTRUCTION)} AS instruction,"
    f" CASE quality WHEN 0 THEN {lit(PROMPT_OUTPUTS[0])} WHEN 1 THEN {lit(PROMPT_OUTPUTS[1])} END AS output"
    " FROM labelled"
)
def prompt_rows(spark, sf_dir):
    docs = labelled(spark, sf_dir).select(
        "doc_id", F.col("text").alias("input"), F.col("quality").alias("label")
    )
    return S.prompt_rows(docs)


@query(
    "SELECT doc_id, "
    + sql_template(TRAIN_PROMPT, options_=lit(TRAIN_OPTIONS), sentence1="text")
    + " AS prompt, "
    + sql_template(SUMMARY_PROMPT, sentence1="text")
    + " AS summary_prompt FROM documents"
)
def template_fill(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        train_prompt(t).alias("prompt"),
        train_prompt(t, SUMMARY_PROMPT).alias("summary_prompt"),
    )


@query(
    f"WITH {PAIRS_SQL} SELECT rid, "
    + sql_template(INFERENCE_WITH_INPUT, instruction="question", input="reply")
    + " AS with_input, "
    + sql_template(INFERENCE_NO_INPUT, instruction="question")
    + " AS no_input FROM pairs"
)
def request_prompts(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select(
        "rid",
        request_prompt(F.col("question"), F.col("reply")).alias("with_input"),
        request_prompt(F.col("question")).alias("no_input"),
    )


@query(
    f"WITH {LABELLED_SQL} SELECT doc_id, "
    + sql_template(TRAIN_PROMPT, options_=lit(TRAIN_OPTIONS), sentence1="text")
    + " AS sources, quality::VARCHAR || '</s>' AS targets FROM labelled"
)
def sft_pairs(spark, sf_dir):
    pairs = source_target_pairs(labelled(spark, sf_dir), "text", "quality", "</s>")
    return pairs.select("doc_id", "sources", "targets")


@query(
    f"WITH {PAIRS_SQL} SELECT rid, "
    + sql_template(
        INSTRUCTION_TEMPLATE, instruction=f"({lit(PROMPT_INSTRUCTION)} || chr(10) || question)"
    )
    + " AS sources, reply || '</s>' AS targets FROM pairs"
)
def instruction_pairs(spark, sf_dir):
    pairs = build_instruction_pairs(
        turn_pairs(spark, sf_dir), F.lit(PROMPT_INSTRUCTION), "question", "reply", "</s>"
    )
    return pairs.select("rid", "sources", "targets")


@query(
    f"WITH {PAIRS_SQL} SELECT rid,"
    " regexp_replace(string_split("
    + sql_template(INFERENCE_PROMPT, options_=lit(SEQ2SEQ_OPTIONS), sentence1="question")
    + f" || '  ' || reply || chr(10), {lit(ANSWER_MARKER)})[-1], '^\\s+|\\s+$', '', 'g') AS answer FROM pairs"
)
def answer_extract(spark, sf_dir):
    prompt = fill_template(
        INFERENCE_PROMPT, {"options_": SEQ2SEQ_OPTIONS, "sentence1": F.col("question")}
    )
    generated = F.concat(prompt, F.lit("  "), F.col("reply"), F.lit("\n"))
    return turn_pairs(spark, sf_dir).select(
        "rid", extract_answer(generated, ANSWER_MARKER).alias("answer")
    )


REPACKED_SQL = sql_repack("packed", "documents", "doc_id", "text", 512, DOC_SEPARATORS)


@query(f"WITH {REPACKED_SQL} SELECT doc_id, text FROM packed")
def repack_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.repack_filter(docs, "text", 512, DOC_SEPARATORS)


BLANK_LINES_SQL = f"""
src AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
{sql_repack('packed', 'src', 'doc_id', 'text', 512, SEPARATORS)}"""


@query(f"WITH {BLANK_LINES_SQL} SELECT doc_id, text FROM packed")
def repack_blank_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
    )
    return S.repack_filter(docs, "text")


PIPES_SQL = f"""
src AS (SELECT doc_id, replace(text, chr(10), {lit(PIPE_SEPARATOR)}) AS text FROM documents),
{sql_repack('packed', 'src', 'doc_id', 'text', 1024, (PIPE_SEPARATOR, *SEPARATORS))}"""


@query(f"WITH {PIPES_SQL} SELECT doc_id, text FROM packed")
def repack_pipes(spark, sf_dir):
    """The rule of the one source whose texts are joined by pipes."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit(PIPE_SEPARATOR)).alias("text")
    )
    return S.repack_filter(docs, "text", 1024, source=PIPE_SOURCE)


@query(
    f"WITH {REPACKED_SQL} SELECT doc_id, text AS input, {lit(PROMPT_INSTRUCTION)} AS instruction,"
    f" {lit(PROMPT_OUTPUTS[1])} AS output, CASE WHEN h < 8 THEN 'train' WHEN h = 8 THEN 'validation' ELSE 'test' END AS split"
    f" FROM (SELECT *, CAST('0x' || substr({sql_shuffle(5, 'doc_id')}, 1, 8) AS BIGINT) % 10 AS h FROM packed)"
)
def stream_clean(spark, sf_dir):
    """The cleaning steps as a stream over the table's files, read back as a table."""
    out = scratch_path(spark, "stream")
    source = table(spark, sf_dir, "documents")

    def step(rows: DataFrame) -> DataFrame:
        return clean_step(rows, "doc_id", index=1, separators=DOC_SEPARATORS)

    # As a pattern the table may be one file or a folder of files.
    path = f"{sf_dir}/{{documents.parquet}}"
    clean_stream(spark, path, f"{out}/rows", f"{out}/state", source.schema, step, "doc_id")
    schema = step(source).withColumn("split", F.lit("")).schema
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    return rows.select("doc_id", "input", "instruction", "output", "split")


@query(
    f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS l FROM documents),
    n AS (SELECT doc_id, l, unnest(range((len(l) + 15) // 16)) AS piece FROM w)
    SELECT doc_id, piece::INTEGER AS piece, array_to_string(l[piece * 16 + 1 : piece * 16 + 16], ' ') AS words FROM n"""
)
def word_chunks(spark, sf_dir):
    pieces = chunk_array(words(F.col("text")), 16)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(pieces).alias("piece", "words")
    ).withColumn("words", F.array_join("words", " "))


# --- order, samples and splits ---------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents")
def exact_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return O.exact_rank(docs, ["n_chars", "doc_id"]).select("doc_id", "rank")


@query(
    "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank FROM documents"
)
def rank_in_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return O.exact_rank(docs, ["n_chars", "doc_id"], within="lang").drop("n_chars")


@query(f"SELECT doc_id, text FROM documents ORDER BY {sql_shuffle(5, 'doc_id')}, doc_id LIMIT 100")
def shuffle_head(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return O.head_n(docs, 100, [O.shuffle_key(5, "doc_id"), "doc_id"], strict=True)


@query(f"SELECT event_id, value FROM events ORDER BY {sql_shuffle(5, 'event_id')}, event_id LIMIT 16")
def sample_k(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return O.sample_k(events, 16, 5, "event_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT (SELECT count(*) // 2 FROM events)")
def first_half(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return O.head_n(events, events.count() // 2, ["ts", "event_id"]).drop("ts")


@query(f"WITH {sql_split('s', 'documents')} SELECT doc_id, split FROM s")
def split_exact(spark, sf_dir):
    return O.split_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    f"""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {sql_shuffle(5, 'event_id')}, event_id)
    <= floor(count(*) OVER () * 5.0::DOUBLE / 100 + 0.5) THEN 'validation' ELSE 'train' END AS split FROM events"""
)
def validation_carve(spark, sf_dir):
    return O.carve_validation(table(spark, sf_dir, "events").select("event_id"), "event_id", 5.0)


@query(
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id, lang FROM r WHERE rn <= (SELECT floor(min(n) * 1.5::DOUBLE) FROM c)"""
)
def balance_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return O.balance(docs, "lang", "doc_id", ratio=1.5)


# --- cleaning plans --------------------------------------------------------

TWO_SOURCES_SQL = f"""
a AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang <> 'en'),
b AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE lang = 'en'),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
both_ AS (
  SELECT 0 AS source, doc_id, text, {lit('ai写的')} AS target FROM a, n WHERE na < nb OR r <= nb
  UNION ALL
  SELECT 1, doc_id, text, {lit('人类写的')} FROM b, n WHERE na >= nb OR r <= na)"""


@query(f"WITH {TWO_SOURCES_SQL}, {sql_split('s', 'both_', ('source', 'doc_id'))} SELECT * FROM s")
def two_source_balance(spark, sf_dir):
    other, english = _by_language(spark, sf_dir)
    return clean_two_sources(other, english, "doc_id")


ZOOM_SQL = TWO_SOURCES_SQL.replace(
    "FROM documents WHERE lang <> 'en')", "FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 50)"
).replace("r <= na)", "r <= 2 * na)")


@query(f"WITH {ZOOM_SQL}, {sql_split('s', 'both_', ('source', 'doc_id'))} SELECT * FROM s")
def two_source_zoom(spark, sf_dir):
    """At most 50 rows of the first source and twice as many of the second."""
    other, english = _by_language(spark, sf_dir)
    return clean_two_sources(other, english, "doc_id", number=50, zoom=2)


MERGED_SQL = """
merged AS (
  SELECT 0 AS source, doc_id AS id, text, 0 AS labels FROM documents
  UNION ALL SELECT 1, item_id, text, 1 FROM benchmark)"""


@query(
    f"""WITH {MERGED_SQL}, {sql_split('s', 'merged', ('source', 'id'))},
    t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {sql_shuffle(42, 'source', 'id')}, source, id) AS rn
          FROM s)
    SELECT * EXCLUDE (rn) FROM t WHERE rn <= CASE split WHEN 'train' THEN 500 ELSE 250 END"""
)
def merge_split_trim(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("content")
    )
    return merge_and_split([docs, items], "id", ["text", "content"], train_length=500)


PROMPT_SQL = f"""
src AS (
  SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS source, doc_id, text AS input FROM documents),
{sql_repack('packed', 'src', 'doc_id', 'input', 512, DOC_SEPARATORS)},
rows_ AS (
  SELECT source, doc_id, input, {lit(PROMPT_INSTRUCTION)} AS instruction,
    CASE source WHEN 0 THEN {lit(PROMPT_OUTPUTS[0])} ELSE {lit(PROMPT_OUTPUTS[1])} END AS output
  FROM packed),
{sql_split('s', 'rows_', ('source', 'doc_id'))}"""


@query(f"WITH {PROMPT_SQL} SELECT * FROM s")
def prompt_merge_split(spark, sf_dir):
    return prompt_merge_and_split(
        _by_language(spark, sf_dir), "doc_id", separators=DOC_SEPARATORS
    )


@query(
    f"""WITH {PROMPT_SQL},
    t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {sql_shuffle(5, 'source', 'doc_id')}, source, doc_id) AS rn
          FROM s)
    SELECT * EXCLUDE (rn) FROM t WHERE rn <= CASE split WHEN 'train' THEN 120 ELSE 60 END"""
)
def prompt_merge_trim(spark, sf_dir):
    return prompt_merge_and_split(
        _by_language(spark, sf_dir), "doc_id", separators=DOC_SEPARATORS, train_length=120
    )


@query(f"WITH {PROMPT_SQL} SELECT split, output, count(*) AS n FROM s GROUP BY split, output")
def prompt_split_counts(spark, sf_dir):
    """The flagship: clean, label, shuffle and split two sources, then count."""
    return prompt_merge_split(spark, sf_dir).groupBy("split", "output").agg(F.count("*").alias("n"))


# --- branches that the tables do not show by themselves ----------------------


@query("SELECT doc_id, text, source FROM documents")
def dropped_columns(spark, sf_dir):
    """Columns removed by name; names that are not there do not matter."""
    return S.drop_columns(table(spark, sf_dir, "documents"), ["lang", "n_chars", "text_size"])


@query(
    f"SELECT doc_id, text AS input, {lit(PROMPT_INSTRUCTION)} AS instruction,"
    f" CASE length(text) % 4 WHEN 0 THEN {lit(PROMPT_OUTPUTS[0])} WHEN 1 THEN {lit(PROMPT_OUTPUTS[1])} END AS output"
    " FROM documents"
)
def prompt_rows_unmatched(spark, sf_dir):
    """Labels 2 and NULL have no output."""
    code = F.length("text") % 4
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("input"), F.when(code < 3, code).alias("label")
    )
    return S.prompt_rows(docs)


@query(
    f"""WITH {PAIRS_SQL}, g AS (
      SELECT rid, reply, CASE turn % 3 WHEN 0 THEN question WHEN 1 THEN '' END AS given
      FROM pairs)
    SELECT rid, """
    + sql_template(
        INSTRUCTION_TEMPLATE,
        instruction=f"({lit(PROMPT_INSTRUCTION)} || CASE WHEN coalesce(given, '') <> '' THEN chr(10) || given ELSE '' END)",
    )
    + " AS sources, reply || '</s>' AS targets FROM g"
)
def instruction_pairs_optional(spark, sf_dir):
    """Inputs that are NULL or empty leave the instruction alone."""
    given = F.when(F.col("turn") % 3 == 0, F.col("question")).when(F.col("turn") % 3 == 1, F.lit(""))
    pairs = turn_pairs(spark, sf_dir).withColumn("given", given)
    pairs = build_instruction_pairs(pairs, F.lit(PROMPT_INSTRUCTION), "given", "reply", "</s>")
    return pairs.select("rid", "sources", "targets")


WIDE_SQL = f"""
src AS (
  SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN replace(replace(text, chr(10), {lit(SEPARATORS[0])}), '. ', '.  ')
    WHEN 1 THEN replace(text, '. ', '.  ')
    ELSE replace(replace(text, chr(10), chr(10) || chr(10)), '. ', '.  ') END AS text
  FROM documents),
{sql_repack('packed', 'src', 'doc_id', 'text', 700, SEPARATORS)}"""


@query(f"WITH {WIDE_SQL} SELECT doc_id, text FROM packed")
def repack_priority(spark, sf_dir):
    """Wide spaces, blank lines and double spaces, alone and together: the first in order wins."""
    text = F.replace("text", F.lit(". "), F.lit(".  "))
    kinds = (
        F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit("\n"), F.lit(SEPARATORS[0])))
        .when(F.col("doc_id") % 3 == 1, text)
        .otherwise(F.replace(text, F.lit("\n"), F.lit("\n\n")))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", kinds.alias("text"))
    return S.repack_filter(docs, "text", 700)


KEYLESS_SQL = f"""
src AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS source, text FROM documents),
keyed AS (
  SELECT source, text, md5(length(text) || '=' || text) || ':' || (row_number() OVER (PARTITION BY source, text) - 1) AS id,
    source AS labels FROM src),
{sql_split('s', 'keyed', ('source', 'id'))}"""


@query(f"WITH {KEYLESS_SQL} SELECT source, id, text, labels, split FROM s")
def keyless_merge(spark, sf_dir):
    """Sources without a key column get one from their values."""
    return merge_and_split([d.drop("doc_id") for d in _by_language(spark, sf_dir)])
