"""Date parsing and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salescope.functions.fixed_values import AMBIGUOUS_DATE_FORMATS, MONTH_NAMES, NAMED_DATE_FORMAT, NUMERIC_DATE_FORMATS


def _read(value: Column, fmt: str) -> Column:
    return F.try_to_timestamp(value, F.lit(fmt)).cast("date")


def _by_shape(value: Column, shapes: dict[str, str]) -> list[Column]:
    return [F.when(value.rlike(shape), _read(value, fmt)) for shape, fmt in shapes.items()]


def _four_digit_year(text: Column, before: str) -> Column:
    """A two-digit year at the end, after ``before``, in full; from 69 on it is of the last century."""
    last = F.regexp_replace(text, rf"^(?<a>{before})(?<b>69|[7-9]\d)$", "${a}19${b}")
    return F.regexp_replace(last, rf"^(?<a>{before})(?<b>\d{{2}})$", "${a}20${b}")


def parse_date(text: Column, day_first: bool = False) -> Column:
    """Date from ISO text (down to ``yyyy-MM``), numbers or month names; null for anything else.

    A time of day is passed over, also between date and year; so are a weekday in front and the ending of an
    ordinal. ``.`` and ``-`` stand for ``/`` in numeric dates; with month names any of ``- / , .`` and blanks
    part the pieces and case does not matter. ``Jan-24`` is a month and a year, ``Jan 24`` may be a day and is
    not read. ``01/05/2024`` is 5 January, or 1 May with ``day_first``; a date that only the other order allows is
    read in that order. ISO text is cast first, letters tell named dates from numeric ones, and a pattern decides
    before a format is tried: a failing format costs far more than the match.
    """
    bare = F.regexp_replace(F.trim(text), r"[ T]\d{1,2}:\d{2}(?::\d{2})? (?:[A-Z]{3,4} )?(\d{4})$", " $1")
    bare = F.regexp_replace(bare, r"[ T]\d{1,2}:\d{2}.*$", "")

    # linear replacements towards "d MMM yyyy": a value used by many patterns would be spelt out in code for each
    named = F.regexp_replace(bare, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[., ]+", "")
    named = _four_digit_year(named, r"\d{1,2}[-/ ][A-Za-z]{3,9}[-/ ]|[A-Za-z]{3,9}[-/']")
    named = F.regexp_replace(named, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    named = F.initcap(F.regexp_replace(named, "[-/',. ]+", " "))
    named = F.regexp_replace(named, "|".join(rf"(?<=\b{m[:3]}){m[3:]}\b" for m in MONTH_NAMES if m[3:]) + r"|(?<=\bSep)t\b", "")
    named = F.regexp_replace(named, r"^(\d{4}) ([A-Z][a-z]{2})(?: (\d{1,2}))?$", "$3 $2 $1")
    named = F.regexp_replace(named, r"^([A-Z][a-z]{2})(?: (\d{1,2}))? (\d{4})$", "$2 $1 $3")
    named = F.regexp_replace(named, r"^ ", "1 ")

    slashed = _four_digit_year(F.regexp_replace(bare, "[.-]", "/"), r"\d{1,2}/\d{1,2}/")
    either = [
        F.when(slashed.rlike(shape), F.coalesce(*[_read(slashed, f) for f in (formats[::-1] if day_first else formats)]))
        for shape, formats in AMBIGUOUS_DATE_FORMATS.items()
    ]
    numeric = F.coalesce(*_by_shape(slashed, NUMERIC_DATE_FORMATS), *either)
    has_month_name = bare.rlike("[A-Za-z]{3}")
    return F.coalesce(text.try_cast("date"), F.when(has_month_name, *_by_shape(named, NAMED_DATE_FORMAT)).otherwise(numeric))


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))
