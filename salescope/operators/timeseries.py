"""Monthly series: totals, gap filling, growth, trends and interpolation.

Two different series exist and keep different names: *sparse* months hold only
months with rows, *filled* months run from the first to the last month with 0
in the gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.dates import month_of, month_text
from salescope.functions.numbers import floor_cents, floor_double, half_even, total
from salescope.functions.text import known


def series_window(keys: Sequence[str]) -> Window:
    """Partition per series. Only for frames already reduced to one row per month."""
    return Window.partitionBy(*(keys or [F.lit(1)]))


def sparse_months(sales: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Exact sums per (keys, month); months without rows are absent."""
    return (
        sales.where(F.col("date").isNotNull())
        .groupBy(*keys, month_of(F.col("date")).alias("month"))
        .agg(total(F.col(value)).alias(value))
    )


def fill_months(monthly: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Insert missing months with 0, between the first and last month of each series.

    Each month is expanded up to the month before its successor, so the months
    are aggregated once and never joined back.
    """
    following = F.lead("month").over(series_window(keys).orderBy("month"))
    span = F.sequence(
        F.col("month"), F.coalesce(F.add_months("_next", -1), F.col("month")), F.expr("interval 1 month")
    )
    zero = F.lit(0).cast(monthly.schema[value].dataType)
    return (
        monthly.withColumn("_next", following)
        .select(*keys, "month", value, F.explode(span).alias("_at"))
        .select(
            *keys,
            F.col("_at").alias("month"),
            F.when(F.col("_at") == F.col("month"), F.col(value)).otherwise(zero).alias(value),
        )
    )


def filled_months(sales: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Gap-filled, floored monthly totals keyed by the first of the month."""
    filled = fill_months(sparse_months(sales, value, keys), value, keys)
    return filled.withColumn(value, floor_double(F.col(value)))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Gap-filled revenue per month, labelled with the last day of the month."""
    return filled_months(sales).select(F.last_day("month").alias("month"), "revenue").orderBy("month")


def monthly_profit(sales: DataFrame) -> DataFrame:
    return filled_months(sales, "profit").select(F.last_day("month").alias("month"), "profit").orderBy("month")


def growth_between(current: Column, previous: Column) -> Column:
    """Relative change: 0 at the start and from 0 to 0, infinite from 0 to anything else."""
    return (
        F.when(previous.isNull(), 0.0)
        .when((previous == 0) & (current == 0), 0.0)
        .when(previous == 0, F.signum(current) * float("inf"))
        .otherwise(current / F.when(previous != 0, previous) - 1)
    )


def growth_of(months: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Month-over-month growth of a floored series, itself floored to 2 decimals.

    Series shorter than two months give no rows.
    """
    series = series_window(keys)
    grown = growth_between(F.col(value), F.lag(value).over(series.orderBy("month")))
    return (
        months.withColumns({"growth": grown, "_months": F.count("*").over(series)})
        .where(F.col("_months") >= 2)
        .select(*keys, "month", floor_cents(F.col("growth")).alias("growth"))
    )


def monthly_growth(sales: DataFrame) -> DataFrame:
    return growth_of(filled_months(sales)).select(F.last_day("month").alias("month"), "growth").orderBy("month")


def growth_stats(growth: DataFrame) -> DataFrame:
    """Counts, extremes, mean and volatility over non-zero finite growth, and the latest month."""
    counted = F.when((F.col("growth") != 0) & (F.abs("growth") != float("inf")), F.col("growth"))
    return growth.agg(
        F.count_if(counted > 0).alias("positive_growth_months"),
        F.count_if(counted < 0).alias("negative_growth_months"),
        F.max(counted).alias("max_growth"),
        F.min(counted).alias("min_growth"),
        F.round(F.avg(counted), 6).alias("avg_growth"),
        half_even(F.stddev_pop(counted), 4).alias("growth_volatility"),
        F.max("month").alias("latest_month"),
        F.max_by("growth", "month").alias("latest_growth"),
    )


def profit_trend(profits: DataFrame) -> DataFrame:
    """Whether the last month's profit is above the first; null below two months."""
    first, last = F.min_by("profit", "month"), F.max_by("profit", "month")
    return profits.agg(
        first.alias("first_profit"),
        last.alias("last_profit"),
        F.when(F.count("*") >= 2, F.when(last > first, "increasing").otherwise("decreasing")).alias("trend"),
    )


def is_declining(values: Column) -> Column:
    """Every value at least its successor, over two or more values; ties decline."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a >= b)
    return (n >= 2) & F.forall(pairs, lambda ok: ok)


def entity_months(sales: DataFrame, entity: str, unknown: bool = False) -> DataFrame:
    """Floored sparse months per entity; null entities are dropped or named Unknown."""
    rows = sales.where(F.col("date").isNotNull() & F.col("revenue").isNotNull())
    rows = rows.withColumn(entity, known(F.col(entity))) if unknown else rows.where(F.col(entity).isNotNull())
    months = sparse_months(rows, "revenue", [entity])
    return months.withColumn("revenue", floor_double(F.col("revenue")))


def entity_trends(months: DataFrame, entity: str, months_to_check: int = 6) -> DataFrame:
    """Per entity: month map, last observed values, total and declining flag.

    An entity collects one value per calendar month, never its raw rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("month", "revenue")))
    trend = F.transform(
        F.slice(F.col("_m"), -F.least(F.lit(months_to_check), F.size("_m")), F.lit(months_to_check)),
        lambda m: m["revenue"],
    )
    by_month = F.map_from_entries(
        F.transform("_m", lambda m: F.struct(month_text(m["month"]), m["revenue"]))
    )
    return (
        months.groupBy(entity)
        .agg(ordered.alias("_m"), F.sum("revenue").alias("total_revenue"))
        .withColumn("trend", trend)
        .select(
            entity,
            by_month.alias("monthly_revenue"),
            "trend",
            "total_revenue",
            is_declining(F.col("trend")).alias("declining"),
        )
    )


def monthly_revenue_by_product(sales: DataFrame) -> DataFrame:
    return entity_trends(entity_months(sales, "product"), "product")


def monthly_revenue_by_customer(sales: DataFrame, months_to_check: int = 6) -> DataFrame:
    return entity_trends(entity_months(sales, "customer", unknown=True), "customer", months_to_check)


def declining_customers(sales: DataFrame, months_to_check: int = 6) -> DataFrame:
    return monthly_revenue_by_customer(sales, months_to_check).where("declining").select("customer").orderBy("customer")


def product_month_table(sales: DataFrame) -> DataFrame:
    """Every product and month with its unfloored revenue and the month as text."""
    rows = sales.where(F.col("revenue").isNotNull() & F.col("product").isNotNull())
    return (
        sparse_months(rows, "revenue", ["product"])
        .select("product", "month", F.col("revenue").cast("double").alias("revenue"), month_text(F.col("month")).alias("month_text"))
        .orderBy("product", "month")
    )


def interpolate_months(months: DataFrame, value: str = "revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Fill null months on a line over days; trailing nulls take the last value, leading stay null."""
    before = series_window(keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    after = series_window(keys).orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    has = F.col(value).isNotNull()
    number = F.col(value).cast("double")
    bounds = months.withColumns(
        {
            "_v0": F.last(number, ignorenulls=True).over(before),
            "_d0": F.last(F.when(has, F.unix_date("month")), ignorenulls=True).over(before),
            "_v1": F.first(number, ignorenulls=True).over(after),
            "_d1": F.first(F.when(has, F.unix_date("month")), ignorenulls=True).over(after),
        }
    )
    share = (F.unix_date("month") - F.col("_d0")) / F.when(F.col("_d1") != F.col("_d0"), F.col("_d1") - F.col("_d0"))
    filled = (
        F.when(has, number)
        .when(F.col("_v0").isNull(), F.lit(None).cast("double"))
        .when(F.col("_v1").isNull(), F.col("_v0"))
        .otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    )
    return bounds.select(*keys, "month", filled.alias(value))
