"""Monthly forecasts, one row per series and step.

Series come as ``keys..., month, revenue`` with one row per month. Simple methods
are column expressions; only model fits run in Python, on one row per series and all
series of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.dates import quarter_label
from salescope.functions.fixed_values import MIN_MONTHS_FORECAST, MIN_MONTHS_PRODUCT, MIN_MONTHS_SEASONAL
from salescope.functions.lookups import single_value
from salescope.functions.numbers import floor_double, plain_number
from salescope.functions.text import display_name
from salescope.operators.models import arima_forecasts, holt_winters_forecasts
from salescope.operators.timeseries import fill_months, filled_months, series_window, sparse_months
from salescope.session import materialise, ship, spread

ARIMA, MOVING_AVERAGE, HOLT_WINTERS = "ARIMA (1,1,1)", "Moving Average", "ETS"
FALLBACK = "Moving Average (fallback)"


def total_series(sales: DataFrame) -> DataFrame:
    """Gap-filled, floored revenue of all sales as the series ``total``."""
    return filled_months(sales.withColumn("series", F.lit("total")), keys=["series"])


def product_series(sales: DataFrame, product: str = "product") -> DataFrame:
    """One gap-filled, floored series per product."""
    named = sales.where(F.col(product).isNotNull()).withColumnRenamed(product, "series")
    return filled_months(named, keys=["series"])


def sufficiency(series: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Months available per series and which models they allow."""
    months = F.col("months_available")
    return series.groupBy(*keys).agg(F.count("*").alias("months_available")).select(
        *keys,
        "months_available",
        (months >= MIN_MONTHS_FORECAST).alias("can_forecast"),
        (months >= MIN_MONTHS_SEASONAL).alias("can_find_seasons"),
    )


def _long_enough(series: DataFrame, keys: Sequence[str], months: int) -> DataFrame:
    counted = series.withColumn("_months", F.count("*").over(series_window(keys)))
    return counted.where(F.col("_months") >= months).drop("_months")


def insufficient(series: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Series too short to forecast, each as one row."""
    short = sufficiency(series, keys).where(~F.col("can_forecast"))
    return short.select(*keys, "months_available", F.lit("insufficient_data").alias("status"))


def _as_rows(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: its last month and its values in order; a series has one value per month."""
    months = F.array_sort(F.collect_list(F.struct("month", F.col("revenue").cast("double").alias("revenue"))))
    listed = series.groupBy(*keys).agg(months.alias("_months"))
    return listed.select(*keys, F.element_at("_months", -1)["month"].alias("_last"), F.col("_months.revenue").alias("_values"))


def _fit(series: DataFrame, keys: Sequence[str], steps: int, methods: Sequence[str], level: float) -> DataFrame:
    """Unfloored model forecasts per series: ``keys, method, step, month, forecast, lower, upper``.

    All series of a batch are fitted together.
    """
    keys = list(keys)
    z = NormalDist().inv_cdf(0.5 + level / 2)
    columns = [*keys, "_last", "method", "step", "forecast", "lower", "upper"]

    def of(pdf: pd.DataFrame, method: str) -> pd.DataFrame:
        values = [np.asarray(v, dtype=float) for v in pdf["_values"]]
        if method == HOLT_WINTERS:
            path = holt_winters_forecasts(values, steps)
            error = np.full(path.shape, np.nan)
        else:
            path, error = arima_forecasts(values, steps, differenced=True)
        failed = ~np.isfinite(path).all(axis=1)
        label = np.where(failed, FALLBACK, method)
        means = np.array([v[-3:].mean() for v in values])
        path, error = np.where(failed[:, None], means[:, None], path), np.where(failed[:, None], np.nan, error)
        out = pdf[[*keys, "_last"]].loc[pdf.index.repeat(steps)].reset_index(drop=True)
        out["method"], out["step"] = np.repeat(label, steps), np.tile(np.arange(1, steps + 1), len(pdf))
        out["forecast"], out["lower"], out["upper"] = path.ravel(), (path - z * error).ravel(), (path + z * error).ravel()
        return out[out["method"] != FALLBACK] if method == HOLT_WINTERS else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for method in methods:
                fitting = pdf if method != HOLT_WINTERS else pdf[pdf["_values"].map(len) >= MIN_MONTHS_SEASONAL]
                if len(fitting):
                    yield of(fitting.reset_index(drop=True), method)[columns]

    key_types = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{key_types}, _last date, method string, step int, forecast double, lower double, upper double"
    ready = _as_rows(_long_enough(series, keys, MIN_MONTHS_FORECAST), keys)
    ship(series.sparkSession)
    bounds = {c: F.when(~F.isnan(c), F.col(c)) for c in ("lower", "upper")}
    fitted = ready.mapInPandas(run, schema).withColumns({"month": F.add_months("_last", F.col("step")), **bounds})
    return fitted.select(*keys, "method", "step", "month", "forecast", "lower", "upper")


def revenue_forecast(series: DataFrame, steps: int = 3, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Floored ARIMA(1,1,1) forecast of every series with at least 12 months."""
    fitted = _fit(series, keys, steps, [ARIMA], 0.95)
    return fitted.select(*keys, "step", "month", floor_double(F.col("forecast")).alias("forecast"), "method")


def forecast_with_bounds(
    series: DataFrame, steps: int = 3, level: float = 0.95, keys: Sequence[str] = ("series",)
) -> DataFrame:
    """Floored ARIMA forecast with its floored confidence bounds."""
    fitted = _fit(series, keys, steps, [ARIMA], level)
    floored = {c: floor_double(F.col(c)) for c in ("forecast", "lower", "upper")}
    return fitted.withColumns(floored).withColumn("level", F.lit(level)).select(
        *keys, "step", "month", "forecast", "lower", "upper", "level", "method"
    )


def explained_forecast(
    series: DataFrame, steps: int = 3, period: str | None = None, keys: Sequence[str] = ("series",)
) -> DataFrame:
    """Direction, mean monthly change and a sentence per series, from all ``steps`` against the last three months."""
    months = F.col("_m")
    history = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "revenue"))).alias("_m")).select(
        *keys,
        F.element_at(months, -1)["revenue"].alias("latest_revenue"),
        F.aggregate(
            F.slice(months, -F.least(F.lit(3), F.size(months)), F.lit(3)), F.lit(0.0), lambda acc, m: acc + m["revenue"]
        ).alias("_sum3"),
    )
    ahead = revenue_forecast(series, steps, keys).groupBy(*keys).agg(
        F.avg("forecast").alias("_ahead"),
        F.min_by("forecast", "step").alias("_next"),
        F.first("method").alias("method"),
    )
    # Put side by side by grouping: a join on the constant key of a single series would be a cross join.
    figures = ["latest_revenue", "_sum3", "_ahead", "_next", "method"]
    joined = (
        ahead.unionByName(history, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*[F.max(c).alias(c) for c in figures])
        .where(F.col("method").isNotNull())
    )
    recent = F.col("_sum3") / 3
    joined = joined.withColumns(
        {
            "trend_direction": F.when(F.col("_ahead") > recent, "increasing").otherwise("decreasing"),
            "avg_monthly_change": F.when(recent > 0, F.abs(F.col("_ahead") - recent) / steps).otherwise(0.0),
        }
    )
    suffix = F.lit(f" for {period}" if period else "")
    modelled = F.concat(
        F.lit("Based on historical trends, revenue is projected to "), "trend_direction", F.lit(" by $"),
        plain_number(F.col("avg_monthly_change")), F.lit(f" per month over the next {steps} months"), suffix,
        F.lit(". Current monthly revenue is $"), plain_number(F.col("latest_revenue")), F.lit("."),
    )
    averaged = F.concat(
        F.lit("Using simple moving average forecast (ARIMA failed). Revenue is projected to be around $"),
        plain_number(F.col("_next")), F.lit(" next month."),
    )
    return joined.select(
        *keys, "trend_direction", "avg_monthly_change", "latest_revenue", "method",
        F.when(F.col("method") == FALLBACK, averaged).otherwise(modelled).alias("explanation"),
    )


def _steps(last_month: Column, steps: int) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct(i.alias("step"), F.add_months(last_month, i).alias("month"))))


def moving_average_forecast(series: DataFrame, steps: int = 3, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Mean of the last three months, repeated; series need 12 months."""
    line = series_window(keys).orderBy("month").rowsBetween(-2, 0)
    last = F.lead("month").over(series_window(keys).orderBy("month")).isNull()
    averaged = (
        _long_enough(series, keys, MIN_MONTHS_FORECAST)
        .withColumns({"_mean": F.avg("revenue").over(line), "_last": last})
        .where("_last")
    )
    return averaged.select(*keys, floor_double(F.col("_mean")).alias("forecast"), _steps(F.col("month"), steps).alias("_s")).select(
        *keys, F.col("_s.step").alias("step"), F.col("_s.month").alias("month"), "forecast", F.lit(MOVING_AVERAGE).alias("method")
    )


def ensemble_forecast(series: DataFrame, steps: int = 3, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Floored mean of the floored ARIMA, moving-average and (from 24 months) Holt-Winters forecasts.

    A fallback of a failed model is not a successful method and stays out.
    """
    columns = [*keys, "step", "month", "forecast", "method"]
    fitted = _fit(series, keys, steps, [ARIMA, HOLT_WINTERS], 0.95).where(F.col("method") != FALLBACK)
    floored = fitted.withColumn("forecast", floor_double(F.col("forecast"))).select(*columns)
    votes = floored.unionByName(moving_average_forecast(series, steps, keys).select(*columns))

    def of(method: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col("forecast")))

    return votes.groupBy(*keys, "step", "month").agg(
        of(ARIMA).alias("arima"),
        of(MOVING_AVERAGE).alias("moving_average"),
        of(HOLT_WINTERS).alias("holt_winters"),
        floor_double(F.avg("forecast")).alias("ensemble"),
    )


# --- per product, method chosen by the series ------------------------------------

_TREND, _ZEROS = "Trend Projection (limited data)", "Moving Average (due to zeros)"
_ARIMA101, _AVERAGE = "ARIMA (1,0,1)", "Simple Average (fallback)"


def observed_product_series(sales: DataFrame, product: str = "product") -> DataFrame:
    """Unfloored revenue per product and month, gaps as 0."""
    rows = sales.where(F.col("revenue").isNotNull() & F.col(product).isNotNull()).withColumnRenamed(product, "product")
    filled = fill_months(sparse_months(rows, keys=["product"]), keys=["product"])
    return filled.withColumn("revenue", F.col("revenue").cast("double"))


def with_strategy(series: DataFrame) -> DataFrame:
    """Each month tagged with its product's method, from length and zeros of the series."""
    per_product = series_window(["product"])
    n = F.col("months_available")
    return series.withColumns(
        {
            "months_available": F.count("*").over(per_product),
            "_zeros": F.count_if(F.col("revenue") == 0).over(per_product),
        }
    ).withColumn(
        "method",
        F.when(n < MIN_MONTHS_PRODUCT, "insufficient_data").when(n < 6, _TREND).when(F.col("_zeros") > 0, _ZEROS).otherwise(_ARIMA101),
    )


def _simple_product_forecasts(tagged: DataFrame, steps: int) -> DataFrame:
    """Growth projection and moving average, without Python."""
    line = series_window(["product"]).orderBy("month")
    before = F.lag("revenue").over(line)
    growth = F.when((before != 0), F.col("revenue") / F.when(before != 0, before) - 1)
    undefined = (before == 0) & (F.col("revenue") != 0)
    summed = (
        tagged.where(F.col("method").isin(_TREND, _ZEROS))
        .withColumns({"_growth": growth, "_undefined": undefined, "_mean3": F.avg("revenue").over(line.rowsBetween(-2, 0))})
        .groupBy("product", "method", "months_available")
        .agg(
            F.max_by("revenue", "month").alias("_last"),
            F.max_by("_mean3", "month").alias("_mean3"),
            F.when(~F.coalesce(F.bool_or("_undefined"), F.lit(False)), F.avg("_growth")).alias("_growth"),
        )
    )
    trending = (F.col("method") == _TREND) & (F.coalesce("_growth", F.lit(0.0)) != 0)
    step = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    projected = F.when(trending, F.col("_last") * F.pow(1 + F.col("_growth"), F.col("step"))).otherwise(F.col("_mean3"))
    return summed.withColumn("step", step).select(
        "product", "method", "months_available", "step", projected.alias("_value")
    )


def _modelled_product_forecasts(tagged: DataFrame, steps: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [np.asarray(v, dtype=float) for v in pdf["_values"]]
            if not values:
                continue
            path, _ = arima_forecasts(values, steps, differenced=False)
            failed = ~np.isfinite(path).all(axis=1)
            means = np.array([v.mean() for v in values])
            out = pdf[["product"]].loc[pdf.index.repeat(steps)].reset_index(drop=True)
            out["method"] = np.repeat(np.where(failed, _AVERAGE, _ARIMA101), steps)
            out["months_available"] = np.repeat([len(v) for v in values], steps)
            out["step"] = np.tile(np.arange(1, steps + 1), len(values))
            out["_value"] = np.where(failed[:, None], means[:, None], path).ravel()
            yield out

    ready = _as_rows(tagged.where(F.col("method") == _ARIMA101).select("product", "month", "revenue"), ["product"])
    ship(tagged.sparkSession)
    return ready.mapInPandas(run, "product string, method string, months_available long, step int, _value double")


def product_forecasts(
    sales: DataFrame, steps: int = 3, product: str = "product", methods: Sequence[str] | None = None
) -> DataFrame:
    """Forecast per product with a method that fits its history.

    Under 3 months nothing is forecast, under 6 growth is projected, series with
    empty months take a moving average, the rest ARIMA(1,0,1) or, should it fail,
    the mean. A growth rate from a zero month is undefined and means the moving
    average. ``methods`` leaves out products that their history gives another method, before
    any model is fitted.
    """
    # one row per product and month, stored, as the latest month and every strategy read it
    series = materialise(observed_product_series(sales, product), "product-series")
    months = series.count()
    tagged = with_strategy(spread(series, months, "product"))
    forecasts = _simple_product_forecasts(tagged, steps)
    if methods is None or _ARIMA101 in methods:
        forecasts = forecasts.unionByName(_modelled_product_forecasts(tagged, steps))
    if methods is not None:
        tagged = tagged.where(F.col("method").isin(*methods))
        forecasts = forecasts.where(F.col("method").isin(*methods))
    latest = single_value(series, F.max("month"))
    per_product = series_window(["product"])
    short = tagged.where(F.col("method") == "insufficient_data").groupBy("product", "method", "months_available").agg(
        F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("_value")
    )
    return (
        spread(forecasts.unionByName(short), months, "product")
        .withColumn("_sum", F.sum("_value").over(per_product))
        .select(
            "product",
            "step",
            F.date_format(F.add_months(latest, F.col("step")), "MMMM yyyy").alias("month_name"),
            floor_double(F.col("_value")).alias("forecast"),
            floor_double(F.col("_sum")).alias("forecast_sum"),
            "method",
            "months_available",
        )
    )


def forecast_horizon(sales: DataFrame, steps: int = 3) -> DataFrame:
    """Label of the forecast period and the month name of each step."""
    latest = sales.agg(F.max("date").alias("_last"))
    first, final = F.add_months("_last", 1), F.add_months("_last", steps)
    label = (
        quarter_label(first)
        if steps == 3
        else F.concat(F.date_format(first, "MMM yyyy"), F.lit(" - "), F.date_format(final, "MMM yyyy"))
    )
    return latest.select(label.alias("period"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "_last").select(
        "period", "step", F.date_format(F.add_months("_last", F.col("step")), "MMMM yyyy").alias("month_name")
    )


def ranked_products(forecasts: DataFrame) -> DataFrame:
    """Products by forecast total, largest first; products without a forecast are left out."""
    totals = forecasts.groupBy("product").agg(F.max("forecast_sum").alias("forecast"))
    return totals.where(F.coalesce("forecast", F.lit(0.0)) != 0).orderBy(F.desc("forecast"), "product")


def top_product(forecasts: DataFrame) -> DataFrame:
    return ranked_products(forecasts).limit(1)


def forecast_chart_series(forecasts: DataFrame) -> DataFrame:
    """Positive totals under display names, largest first."""
    shown = ranked_products(forecasts).where(F.col("forecast") > 0)
    return shown.select(display_name(F.col("product")).alias("product"), "forecast").orderBy(F.desc("forecast"), "product")


def forecast_trends(forecasts: DataFrame) -> DataFrame:
    """Last step against the first per product; stable with fewer than two steps."""
    first, last = F.min_by("forecast", "step"), F.max_by("forecast", "step")
    return forecasts.groupBy("product").agg(
        F.when(F.count("step") < 2, "stable").when(last > first, "increasing").otherwise("decreasing").alias("trend")
    )


def average_forecast(series: DataFrame, steps: int = 3, keys: Sequence[str] = ("product",)) -> DataFrame:
    """The mean of the whole history for every step."""
    mean = series.groupBy(*keys).agg(F.avg("revenue").alias("_mean"))
    return mean.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *keys,
        "step",
        floor_double(F.col("_mean")).alias("forecast"),
        floor_double(F.col("_mean") * steps).alias("forecast_sum"),
        F.lit(_AVERAGE).alias("method"),
    )
