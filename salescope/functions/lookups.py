"""Small helpers for joins, day lists and single values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_spine(spark, as_of: str, days: int, name: str = "day") -> DataFrame:
    """The ``days`` calendar days ending at ``as_of``."""
    last = F.to_date(F.lit(as_of))
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last, F.expr("interval 1 day"))).alias(name)
    )


def single_value(df: DataFrame, value: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery."""
    return df.agg(value.alias("value")).scalar()


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, so rows without a key are kept."""
    names = {k: f"_same_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())
