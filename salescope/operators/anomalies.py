"""Months far from the mean, and seasonal structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.fixed_values import MIN_MONTHS_SEASONAL, SEASONAL_STRENGTH_MARK
from salescope.functions.numbers import half_even, plain_number
from salescope.functions.text import display_name
from salescope.operators.timeseries import filled_months, series_window, sparse_months


def _outliers(months: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """Months strictly outside mean +- threshold * sample deviation, with three or more months."""
    series = series_window(keys)
    value = F.col("revenue").cast("double")
    judged = months.withColumns(
        {
            "average": F.avg(value).over(series),
            "_dev": F.stddev_samp(value).over(series),
            "_months": F.count("*").over(series),
        }
    ).withColumn("revenue", value)
    kind = F.when(F.col("revenue") > F.col("average") + threshold * F.col("_dev"), "spike").when(
        F.col("revenue") < F.col("average") - threshold * F.col("_dev"), "drop"
    )
    return judged.withColumn("kind", kind).where((F.col("_months") >= 3) & F.col("kind").isNotNull())


def revenue_anomalies(sales: DataFrame, threshold: float = 2) -> DataFrame:
    """Every spike and drop month of total revenue.

    A result keyed by one label can hold only the last spike; here each month is
    a row.
    """
    found = _outliers(filled_months(sales), threshold, [])
    shown, usual = plain_number(F.col("revenue")), plain_number(F.col("average"))
    text = F.when(
        F.col("kind") == "spike", F.concat(F.lit("Revenue spike detected: $"), shown, F.lit(" (vs average $"), usual, F.lit(")"))
    ).otherwise(F.concat(F.lit("Revenue dropped to $"), shown, F.lit(" (vs average $"), usual, F.lit(")")))
    return found.select(
        F.last_day("month").alias("month"), "kind", "revenue", F.round("average", 6).alias("average"), text.alias("text")
    ).orderBy("month")


def product_anomalies(sales: DataFrame, threshold: float = 2) -> DataFrame:
    """Spikes and drops per product on its observed months, one row each."""
    named = sales.where(F.col("product").isNotNull())
    found = _outliers(sparse_months(named, "revenue", ["product"]), threshold, ["product"])
    shown, usual, name = plain_number(F.col("revenue")), plain_number(F.col("average")), display_name(F.col("product"))
    text = F.when(
        F.col("kind") == "spike",
        F.concat(
            F.lit("The revenue was $"), shown, F.lit(", which is significantly higher than the average of $"), usual,
            F.lit(" for "), name,
        ),
    ).otherwise(
        F.concat(
            F.lit("The revenue dropped significantly to $"), shown, F.lit(", which is much lower than the average of $"),
            usual, F.lit(" for "), name,
        )
    )
    return found.select(
        name.alias("product"), "month", "kind", "revenue", F.round("average", 6).alias("average"), text.alias("text")
    ).orderBy("product", "month")


def anomaly_count(sales: DataFrame, threshold: float = 2) -> DataFrame:
    return _outliers(filled_months(sales), threshold, []).agg(F.count("*").alias("anomaly_count"))


def decompose(months: DataFrame) -> DataFrame:
    """Additive split of a filled monthly series: trend, seasonal, residual.

    The trend is a centred mean over 12 months with half-weighted ends and is
    null for the first and last six months.
    """
    line = series_window([]).orderBy("month")
    everything = series_window([])
    back, ahead = line.rowsBetween(-6, 5), line.rowsBetween(-5, 6)
    inside = (F.row_number().over(line) > 6) & (F.count("*").over(everything) - F.row_number().over(line) >= 6)
    trended = months.withColumn(
        "trend", F.when(inside, (F.sum("revenue").over(back) + F.sum("revenue").over(ahead)) / 24)
    ).withColumn("_detrended", F.col("revenue") - F.col("trend"))
    typical = trended.withColumns(
        {
            "calendar_month": F.month("month"),
            "_typical": F.avg("_detrended").over(Window.partitionBy(F.month("month"))),
        }
    )
    # Each calendar month weighs once in the centring, however often it occurs.
    weight = 1 / F.count("*").over(Window.partitionBy("calendar_month"))
    centred = typical.withColumn("_weight", weight)
    centre = F.sum(F.col("_typical") * F.col("_weight")).over(everything) / F.sum("_weight").over(everything)
    return (
        centred.withColumn("seasonal", F.col("_typical") - centre)
        .withColumn("residual", F.col("_detrended") - F.col("seasonal"))
        .select("month", "calendar_month", "revenue", "trend", "seasonal", "residual")
    )


def seasonal_pattern(sales: DataFrame) -> DataFrame:
    """Mean seasonal effect per calendar month (January is 1)."""
    return (
        decompose(filled_months(sales))
        .groupBy("calendar_month")
        .agg(F.round(F.avg("seasonal"), 4).alias("effect"))
        .orderBy("calendar_month")
    )


def seasonality(sales: DataFrame) -> DataFrame:
    """Whether revenue is seasonal, how strongly, and its peak and trough months.

    Months are true calendar months; a 0-based position read as a month number
    would name the month before.
    """
    stats = decompose(filled_months(sales)).agg(
        F.count("*").alias("months_available"),
        F.var_samp("residual").alias("_noise"),
        F.var_samp("seasonal").alias("_signal"),
        F.max_by("month", F.struct(F.round("seasonal", 6), -F.col("calendar_month"))).alias("_peak"),
        F.min_by("month", F.struct(F.round("seasonal", 6), "calendar_month")).alias("_trough"),
    )
    enough = F.col("months_available") >= MIN_MONTHS_SEASONAL
    strength = F.when(F.col("_signal") > 0, 1 - F.col("_noise") / F.col("_signal")).otherwise(F.lit(0.0))
    judged = stats.withColumn("_strength", F.when(enough, strength))
    seasonal = F.coalesce(F.col("_strength") > SEASONAL_STRENGTH_MARK, F.lit(False))
    message = (
        F.when(~enough, "Insufficient data for seasonality detection (need at least 24 months)")
        .when(~seasonal, "No strong seasonal pattern detected")
        .otherwise(
            F.concat(
                F.lit("Strong seasonal pattern detected. Revenue typically peaks in "),
                F.date_format("_peak", "MMMM"), F.lit(" and troughs in "), F.date_format("_trough", "MMMM"), F.lit("."),
            )
        )
    )
    return judged.select(
        seasonal.alias("has_seasonality"),
        "months_available",
        half_even(F.col("_strength"), 2).alias("strength"),
        F.when(seasonal, F.date_format("_peak", "MMMM")).alias("peak_month"),
        F.when(seasonal, F.date_format("_trough", "MMMM")).alias("trough_month"),
        message.alias("message"),
    )
