"""Rounding and division rules shared by every operator."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond this a double no longer holds every integer, so flooring it is a no-op
# and Spark's bigint floor would saturate.
_EXACT_INTEGERS = 9e15


def floor_double(value: Column) -> Column:
    """Floor as a double; null stays null, infinities and huge values pass through."""
    number = value.cast("double")
    return F.when(F.abs(number) < _EXACT_INTEGERS, F.floor(value).cast("double")).otherwise(number)


def floor_or_zero(value: Column) -> Column:
    """Floor as a double with null counted as 0."""
    return F.coalesce(floor_double(value), F.lit(0.0))


def floor_cents(value: Column) -> Column:
    """Floor to two decimals in double arithmetic."""
    number = value.cast("double")
    return F.when(F.abs(number) < _EXACT_INTEGERS / 100, F.floor(number * 100).cast("double") / 100).otherwise(number)


def to_money(value: Column) -> Column:
    """Floor to cents, then fix as a decimal so that sums are exact in any order.

    Whole cents become a decimal directly; going through a double's digits costs
    noticeably more per row. Amounts no decimal(18,2) can hold become null.
    """
    number = value.cast("double")
    cents = F.floor(number * 100).cast("decimal(18,0)") * F.lit(Decimal("0.01"))
    usual = F.abs(number) < _EXACT_INTEGERS / 100
    return F.when(usual, cents.cast("decimal(18,2)")).otherwise(number.try_cast("decimal(18,2)"))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value.cast("double"), digits)


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """Division that yields ``default`` on a zero or missing denominator."""
    safe = F.when(bottom != 0, top.cast("double") / bottom.cast("double"))
    return safe if default is None else F.coalesce(safe, F.lit(float(default)))


def total(value: Column) -> Column:
    """Sum where a column of nulls adds up to 0."""
    return F.coalesce(F.sum(value), F.lit(0).cast("decimal(18,2)"))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def plain_number(value: Column) -> Column:
    """Thousands-grouped text without decimals, half-even."""
    return F.format_number(value.cast("double"), 0)
