"""Key figures, revenue breakdowns and top-k over the canonical sales table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.dates import month_of
from salescope.functions.fixed_values import (
    ASSUMED_COST_SHARE,
    ASSUMED_MARGIN,
    COST_NAME_HINTS,
    REVENUE_NAME_HINTS,
)
from salescope.functions.lookups import single_value
from salescope.functions.numbers import floor_cents, floor_double, floor_or_zero, half_even, ratio, total
from salescope.functions.text import known
from salescope.session import materialise


def _margin(profit: Column, revenue: Column) -> Column:
    return F.when(revenue > 0, floor_cents(profit / revenue)).otherwise(F.lit(0.0))


def _order_value(df: DataFrame, revenue: Column) -> Column:
    # Rows that are sums already say how many values they hold.
    values = F.sum("revenue_rows") if "revenue_rows" in df.columns else F.count(revenue)
    return floor_or_zero(ratio(F.sum(revenue), values))


def kpis(sales: DataFrame) -> DataFrame:
    """Total revenue, cost, profit, margin and average order value, one row.

    Totals are floored before profit is taken. Without a cost column the cost is
    0 and the margin 1; without a revenue column other names are tried.
    """
    if "revenue" not in sales.columns:
        return kpis_from_similar_names(sales).drop("cost_estimated")
    revenue = F.col("revenue")
    has_cost = "cost" in sales.columns
    sums = sales.agg(
        floor_or_zero(F.sum(revenue)).alias("total_revenue"),
        (floor_or_zero(F.sum("cost")) if has_cost else F.lit(0.0)).alias("total_cost"),
        _order_value(sales, revenue).alias("avg_order_value"),
    )
    profit = F.col("total_revenue") - F.col("total_cost")
    margin = _margin(profit, F.col("total_revenue")) if has_cost else F.lit(1.0)
    return sums.select(
        "total_revenue", "total_cost", profit.alias("total_profit"), margin.alias("profit_margin"), "avg_order_value"
    )


def _first_named(columns: list[str], hints: list[str]) -> str | None:
    return next((c for c in columns if any(h in c.lower() for h in hints)), None)


def kpis_from_similar_names(df: DataFrame) -> DataFrame:
    """Key figures when columns only resemble revenue and cost.

    With no cost-like column the cost is estimated as 60 % of revenue.
    """
    revenue_name = _first_named(df.columns, REVENUE_NAME_HINTS)
    if revenue_name is None:
        raise ValueError(f"no revenue column among {df.columns}")
    cost_name = _first_named(df.columns, COST_NAME_HINTS)
    revenue = F.col(revenue_name)
    cost = floor_or_zero(F.sum(cost_name)) if cost_name else F.lit(None).cast("double")
    sums = df.agg(
        floor_or_zero(F.sum(revenue)).alias("total_revenue"),
        cost.alias("_cost"),
        _order_value(df, revenue).alias("avg_order_value"),
    )
    estimated = cost_name is None
    spent = floor_double(F.col("total_revenue") * ASSUMED_COST_SHARE) if estimated else F.col("_cost")
    frame = sums.withColumn("total_cost", spent)
    profit = F.col("total_revenue") - F.col("total_cost")
    margin = F.lit(ASSUMED_MARGIN) if estimated else _margin(profit, F.col("total_revenue"))
    return frame.select(
        "total_revenue",
        "total_cost",
        profit.alias("total_profit"),
        margin.alias("profit_margin"),
        "avg_order_value",
        F.lit(estimated).alias("cost_estimated"),
    )


def _empty(sales: DataFrame, schema: str) -> DataFrame:
    return sales.sparkSession.createDataFrame([], schema)


def revenue_by(sales: DataFrame, dimension: str) -> DataFrame:
    """Floored revenue per label, largest first; unlabelled rows count as Unknown."""
    if dimension not in sales.columns:
        return _empty(sales, f"{dimension} string, revenue double")
    return (
        sales.groupBy(known(F.col(dimension)).alias(dimension))
        .agg(total(F.col("revenue")).alias("_sum"))
        .orderBy(F.desc("_sum"), dimension)
        .select(dimension, floor_double(F.col("_sum")).alias("revenue"))
    )


def revenue_by_payment_status(sales: DataFrame) -> DataFrame | None:
    """Floored revenue per payment status in label order; None without the column."""
    if "payment_status" not in sales.columns:
        return None
    return (
        sales.groupBy(known(F.col("payment_status"), "unknown").alias("payment_status"))
        .agg(floor_or_zero(F.sum("revenue")).alias("revenue"))
        .orderBy("payment_status")
    )


def total_units(sales: DataFrame) -> DataFrame | None:
    if "quantity" not in sales.columns:
        return None
    return sales.agg(floor_or_zero(F.sum("quantity")).alias("total_units"))


def revenue_per_unit(sales: DataFrame) -> DataFrame | None:
    """Floored revenue over units; null when no units were sold."""
    if "quantity" not in sales.columns:
        return None
    return sales.agg(floor_double(ratio(F.sum("revenue"), F.sum("quantity"))).alias("revenue_per_unit"))


def top_by_revenue(sales: DataFrame, dimension: str, n: int = 5) -> DataFrame:
    """The ``n`` labels with most revenue, on floored revenue with the label breaking ties."""
    return (
        sales.groupBy(known(F.col(dimension)).alias(dimension))
        .agg(floor_or_zero(F.sum("revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), dimension)
        .limit(n)
    )


def revenue_concentration(sales: DataFrame, dimension: str = "customer", n: int = 5) -> DataFrame:
    """Share of the ``n`` largest labels in total revenue, percent with one decimal."""
    # summed once per label and stored, as the total and the top are taken from it
    labels = materialise(sales.groupBy(known(F.col(dimension)).alias(dimension)).agg(F.sum("revenue").alias("revenue")), "revenue-by-label")
    everything = single_value(labels, floor_or_zero(F.sum("revenue")))
    return top_by_revenue(labels, dimension, n).agg(F.sum("revenue").alias("top_revenue")).select(
        "top_revenue",
        everything.alias("total_revenue"),
    ).withColumn(
        "concentration_pct",
        F.when(F.col("total_revenue") > 0, half_even(F.col("top_revenue") / F.col("total_revenue") * 100, 1)),
    )


def revenue_at_risk(sales: DataFrame) -> DataFrame:
    """Failed and pending revenue, their sum, and its share of all revenue."""

    def with_status(name: str) -> Column:
        return floor_or_zero(F.sum(F.when(F.col("payment_status") == name, F.col("revenue"))))

    sums = sales.agg(
        with_status("failed").alias("failed_revenue"),
        with_status("pending").alias("pending_revenue"),
        floor_or_zero(F.sum("revenue")).alias("total_revenue"),
    )
    risk = F.col("failed_revenue") + F.col("pending_revenue")
    return sums.select(
        "failed_revenue",
        "pending_revenue",
        risk.alias("revenue_at_risk"),
        F.when(F.col("total_revenue") > 0, half_even(risk / F.col("total_revenue") * 100, 1)).alias("at_risk_pct"),
    )


def outstanding_revenue(sales: DataFrame) -> DataFrame:
    """Revenue not yet paid: pending plus failed."""
    return revenue_at_risk(sales).select(F.col("revenue_at_risk").alias("outstanding_revenue"))


def paid_revenue_by_month_and_region(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("payment_status") == "paid")
        .groupBy(month_of(F.col("date")).alias("month"), "region")
        .agg(
            F.sum("revenue").cast("double").alias("total_revenue"),
            F.count("*").alias("transaction_count"),
            ratio(F.sum("revenue"), F.count("revenue")).alias("avg_transaction_value"),
        )
        .orderBy(F.desc("month"), "region")
    )


def customer_lifetime_value(sales: DataFrame) -> DataFrame:
    """Paid purchases of named customers: count, spend, average, first and last day."""
    return (
        sales.where((F.col("payment_status") == "paid") & F.col("customer").isNotNull())
        .groupBy("customer")
        .agg(
            F.count("*").alias("purchase_count"),
            F.sum("revenue").cast("double").alias("total_spent"),
            ratio(F.sum("revenue"), F.count("revenue")).alias("avg_purchase_value"),
            F.min("date").alias("first_purchase"),
            F.max("date").alias("last_purchase"),
        )
        .orderBy(F.desc("total_spent"), "customer")
    )


def trend_profile(monthly: DataFrame, entity: str = "product") -> DataFrame:
    """Total, mean, best and worst month per entity; the first month wins ties.

    ``monthly`` has one floored ``revenue`` per entity and ``month``.
    """
    age = -F.unix_date("month")
    return (
        monthly.groupBy(entity)
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.avg("revenue").alias("avg_revenue"),
            F.max("revenue").alias("best_revenue"),
            F.max_by("month", F.struct("revenue", age)).alias("best_month"),
            F.min("revenue").alias("worst_revenue"),
            F.min_by("month", F.struct("revenue", F.unix_date("month"))).alias("worst_month"),
        )
        .where(F.col("total_revenue") > 0)
        .orderBy(F.desc("total_revenue"), entity)
    )
