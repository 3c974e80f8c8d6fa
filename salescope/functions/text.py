"""Labels and display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column, fallback: str = "Unknown") -> Column:
    """Null and empty labels get a name; blanks are kept as they are."""
    return F.when(value.isNull() | (value == ""), F.lit(fallback)).otherwise(value)


def display_name(value: Column) -> Column:
    """Underscores to spaces and ``Plan`` set apart, without doubled spaces."""
    spaced = F.replace(F.replace(value, F.lit("_"), F.lit(" ")), F.lit("Plan"), F.lit(" Plan"))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def estimated_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")
