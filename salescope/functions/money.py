"""Currency codes, money text and conversion as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from salescope.functions.fixed_values import CURRENCY_SYMBOLS, CURRENCY_WORDS, RATES_TO_USD
from salescope.functions.text import contains_any

_DROPPED = "".join(CURRENCY_SYMBOLS) + " \t\n\r\u00a0\u202f"
# Digits with separators and an optional exponent; keeps words such as "10d" from parsing.
_MONEY = r"^[+-]?[0-9.,]*[0-9][0-9.,]*([eE][+-]?[0-9]+)?$"


def _lookup(key: Column, table: Mapping[str, object]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def currency_code(raw: Column, target: str = "USD") -> Column:
    """Symbol, known code or wording to a currency code; anything else is ``target``."""
    text = F.upper(F.trim(raw.cast("string")))
    codes = {code: code for code in sorted(set(RATES_TO_USD) | set(CURRENCY_SYMBOLS.values()))}
    by_word = reduce(
        lambda chain, rule: chain.when(F.startswith(text, F.lit(rule[1])) | contains_any(text, rule[2]), rule[0]),
        CURRENCY_WORDS[1:],
        F.when(
            F.startswith(text, F.lit(CURRENCY_WORDS[0][1])) | contains_any(text, CURRENCY_WORDS[0][2]),
            CURRENCY_WORDS[0][0],
        ),
    )
    return F.coalesce(_lookup(text, {**CURRENCY_SYMBOLS, **codes}), by_word, F.lit(target))


def bare_money_text(raw: Column) -> Column:
    """Money text without currency symbols and blanks."""
    return F.translate(raw.cast("string"), _DROPPED, "")


def money_value(text: Column) -> Column:
    """Bare money text to double, telling US and European separators apart.

    With both separators the later one is the decimal point. A lone comma is a
    decimal point only when exactly two characters follow the last one.
    The text is used several times: pass a column, not an expression.
    """
    backwards = F.reverse(text)
    comma, dot = F.instr(backwards, ","), F.instr(backwards, ".")
    no_commas = F.translate(text, ",", "")
    european = F.translate(text, ",.", ".")
    cleaned = (
        F.when(comma == 0, text)
        .when((dot > 0) & (dot > comma), european)
        .when((dot == 0) & (comma == 3), F.translate(text, ",", "."))
        .otherwise(no_commas)
    )
    return F.when(text.rlike(_MONEY), cleaned.try_cast("double"))


def rate_to(code: Column, target: str = "USD", to_usd: Mapping[str, float] | None = None) -> Column:
    """Rate from ``code`` into ``target``; an unknown currency keeps its amount."""
    table = to_usd or RATES_TO_USD
    base = table[target]
    return F.coalesce(_lookup(code, {c: r / base for c, r in table.items()}), F.lit(1.0))
