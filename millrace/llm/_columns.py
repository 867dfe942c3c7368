"""Column helpers for operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gaps between words, as a character class and as the characters themselves.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of `[^\\x20\\x09-\\x0D]` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def computed_once(frame: DataFrame, kept: list[str], **values: Column) -> DataFrame:
    """The columns `kept` and the values, each computed once for a row.

    The values come out of a generator of one row, through which Spark pushes no filter upon them,
    so a filter doesn't repeat their expressions.
    """
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return frame.select(*kept, F.inline_outer(F.array(row)))
