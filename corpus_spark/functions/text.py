"""Column functions on text."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_spark.constants import (
    INPUT_MAX_LENGTH,
    PIPE_SEPARATOR,
    PIPE_SOURCE,
    SEPARATORS,
)
from corpus_spark.functions.arrays import bind

__all__ = [
    "words",
    "characters",
    "tokens",
    "strip",
    "text_length",
    "text_size",
    "literal_split",
    "fill_template",
    "instruction_with_input",
    "extract_answer",
    "repack",
    "fits",
]

# Everything Python's str.split() and str.strip() treat as white space.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def literal_split(text: Column, sep: str) -> Column:
    """Split on a literal separator and keep trailing empty parts."""
    return F.split(text, re.escape(sep), -1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_SPACE), "")


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def tokens(text: Column, mode: str = "word", specials: Sequence[str] = ()) -> Column:
    """Words or characters of a text; special tokens in it stay whole words."""
    if mode == "char":
        return characters(text)
    if mode != "word":
        raise ValueError(f"unknown token mode: {mode}")
    for special in specials:
        text = F.replace(text, F.lit(special), F.lit(f" {special} "))
    return words(text)


def strip(text: Column) -> Column:
    edge = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
    return F.regexp_replace(text, edge, "")


def text_length(text: Column) -> Column:
    """Number of code points."""
    return F.length(text)


def text_size(text: Column) -> Column:
    """Number of words."""
    return F.size(words(text))


def fill_template(template: str, slots: Mapping[str, Column | str]) -> Column:
    """Fill the named slots of a format string.

    The template is cut up once, so a slot's text is never searched for further
    slots. A NULL slot makes the result NULL.
    """
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = slots[name]
            parts.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def instruction_with_input(instruction: Column, text: Column) -> Column:
    """The instruction, followed by the input on a new line where there is one."""
    return F.when(
        text.isNotNull() & (text != ""), F.concat(instruction, F.lit("\n"), text)
    ).otherwise(instruction)


def extract_answer(text: Column, marker: str) -> Column:
    """The stripped text after the last marker; the whole text without one."""
    return strip(F.substring_index(text, marker, -1))


def repack(
    text: Column,
    max_length: int = INPUT_MAX_LENGTH,
    separators: Sequence[str] = SEPARATORS,
    source: str | None = None,
) -> Column:
    """Join the leading segments of a text that fit into ``max_length``.

    The first separator present decides the segments. Too long segments are
    skipped; the first candidate that would grow too long ends the walk. A text
    without any separator stays unchanged; no fitting segment gives NULL.
    """
    tried = list(separators)
    if source == PIPE_SOURCE:
        tried.insert(0, PIPE_SEPARATOR)
    if not tried:
        return text
    segments = F
    for sep in tried:
        segments = segments.when(F.contains(text, F.lit(sep)), literal_split(text, sep))

    limit = F.lit(max_length)
    start = F.struct(F.lit(None).cast("string").alias("kept"), F.lit(False).alias("full"))

    def step(state: Column, segment: Column) -> Column:
        kept = state["kept"]
        grown = F.coalesce(F.length(kept) + 1, F.lit(0)) + F.length(segment)
        return (
            F.when(state["full"], state)
            .when(grown > limit, F.struct(kept.alias("kept"), F.lit(True).alias("full")))
            .otherwise(
                F.struct(
                    F.when(kept.isNull(), segment)
                    .otherwise(F.concat(kept, F.lit("\n"), segment))
                    .alias("kept"),
                    F.lit(False).alias("full"),
                )
            )
        )

    def join_fitting(parts: Column) -> Column:
        # Every kept part after the first adds at least its line break.
        fitting = F.slice(F.filter(parts, lambda s: F.length(s) <= limit), 1, max_length + 1)
        return F.when(parts.isNull(), text).otherwise(
            F.aggregate(fitting, start, step, lambda state: state["kept"])
        )

    return bind(segments, join_fitting)


def fits(text: Column, max_length: int = INPUT_MAX_LENGTH) -> Column:
    """True for a text of at most ``max_length``; NULL never passes."""
    return F.length(text) <= F.lit(max_length)
