"""Forecasts over the sales table."""

from __future__ import annotations

from pyspark.sql import functions as F

from salescope.operators import forecast
from salescope.plans.tables import over_sales, sales

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _total(spark, sf_dir):
    return forecast.total_series(sales(spark, sf_dir, ["date", "revenue"]))


def _brands(spark, sf_dir):
    return forecast.product_series(sales(spark, sf_dir, ["date", "brand", "revenue"]), "brand")


def customer_years(spark, sf_dir):
    """Sales with a customer's year as the product: short and intermittent series."""
    return sales(spark, sf_dir, ["date", "customer", "revenue"]).select(
        "date", "revenue", F.concat(F.col("customer"), F.lit("/"), F.year("date").cast("string")).alias("product")
    )


def series_sql(key: str, floored: bool = True) -> str:
    value = "CAST(floor(SUM(revenue)) AS DOUBLE)" if floored else "CAST(SUM(revenue) AS DOUBLE)"
    return f"""
, keyed AS (SELECT {key} AS series, date_trunc('month', date)::DATE AS month, {value} AS revenue
            FROM sales WHERE date IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2)
, ends AS (SELECT series, min(month) AS a, max(month) AS b FROM keyed GROUP BY 1)
, grid AS (SELECT series, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM ends)
, filled AS (SELECT series, month, coalesce(revenue, 0) AS revenue,
                    row_number() OVER (PARTITION BY series ORDER BY month DESC) AS back,
                    count(*) OVER (PARTITION BY series) AS n FROM grid LEFT JOIN keyed USING (series, month))
"""


_add(
    "filled_months_by_customer",
    # A customer buys in few months, so most months are filled in.
    lambda s, d: forecast.product_series(sales(s, d, ["date", "customer", "revenue"]), "customer"),
    over_sales(series_sql("customer") + "SELECT series, month, revenue FROM filled"),
)
_add(
    "forecast_sufficiency",
    lambda s, d: forecast.sufficiency(_brands(s, d)),
    over_sales(series_sql("brand") + """
SELECT series, count(*) AS months_available, count(*) >= 12 AS can_forecast, count(*) >= 24 AS can_find_seasons FROM filled GROUP BY 1"""),
)
_add("forecast_revenue", lambda s, d: forecast.revenue_forecast(_total(s, d)))
_add("forecast_revenue_by_brand", lambda s, d: forecast.revenue_forecast(_brands(s, d)))
_add("forecast_with_bounds", lambda s, d: forecast.forecast_with_bounds(_total(s, d)))
_add("forecast_explained", lambda s, d: forecast.explained_forecast(_total(s, d), period="next quarter"))
_add("forecast_ensemble", lambda s, d: forecast.ensemble_forecast(_total(s, d)))
_add("forecast_ensemble_by_brand", lambda s, d: forecast.ensemble_forecast(_brands(s, d)))
_add(
    "forecast_moving_average",
    lambda s, d: forecast.moving_average_forecast(_brands(s, d)),
    over_sales(series_sql("brand") + """
, m AS (SELECT series, max(month) AS month, floor(avg(revenue) FILTER (back <= 3)) AS forecast FROM filled WHERE n >= 12 GROUP BY 1)
SELECT series, CAST(i AS INTEGER) AS step, CAST(month + INTERVAL 1 MONTH * i AS DATE) AS month, forecast, 'Moving Average' AS method
FROM m, range(1, 4) r(i)"""),
)
_add(
    "forecast_insufficient_series",
    lambda s, d: forecast.insufficient(forecast.product_series(customer_years(s, d))),
    over_sales(series_sql("customer || '/' || year(date)") + """
SELECT series, count(*) AS months_available, 'insufficient_data' AS status FROM filled GROUP BY 1 HAVING count(*) < 12"""),
)
_add(
    "forecast_average",
    lambda s, d: forecast.average_forecast(forecast.observed_product_series(sales(s, d, ["date", "brand", "revenue"]), "brand")),
    over_sales(series_sql("brand", floored=False) + """
SELECT series AS product, CAST(i AS INTEGER) AS step, floor(avg(revenue)) AS forecast, floor(avg(revenue) * 3) AS forecast_sum,
       'Simple Average (fallback)' AS method FROM filled, range(1, 4) r(i) GROUP BY 1, 2"""),
)
_add("forecast_by_brand", lambda s, d: forecast.product_forecasts(sales(s, d, ["date", "brand", "revenue"]), product="brand"))
PRODUCT_SQL = series_sql("customer || '/' || year(date)", floored=False) + """
, lagged AS (SELECT *, lag(revenue) OVER (PARTITION BY series ORDER BY month) AS before FROM filled)
, st AS (SELECT series, any_value(n) AS n, count(*) FILTER (revenue = 0) AS zeros, max(revenue) FILTER (back = 1) AS last,
                avg(revenue) FILTER (back <= 3) AS mean3,
                CASE WHEN count(*) FILTER (before = 0 AND revenue <> 0) = 0 THEN avg(revenue / nullif(before, 0) - 1) END AS g
         FROM lagged GROUP BY 1)
, chosen AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient_data' WHEN n < 6 THEN 'Trend Projection (limited data)'
                            WHEN zeros > 0 THEN 'Moving Average (due to zeros)' ELSE 'ARIMA (1,0,1)' END AS method FROM st)
, steps AS (SELECT *, CASE WHEN n < 6 AND coalesce(g, 0) <> 0 THEN last * pow(1 + g, i) ELSE mean3 END AS v
            FROM chosen, range(1, 4) r(i) WHERE method IN ('Trend Projection (limited data)', 'Moving Average (due to zeros)'))
, latest AS (SELECT max(month) AS lm FROM keyed)
, allrows AS (SELECT series AS product, CAST(i AS INTEGER) AS step, strftime(lm + INTERVAL 1 MONTH * i, '%B %Y') AS month_name, floor(v) AS forecast,
                     floor(SUM(v) OVER (PARTITION BY series)) AS forecast_sum, method, n AS months_available FROM steps, latest
              UNION ALL SELECT series, NULL, NULL, NULL, NULL, method, n FROM chosen WHERE method = 'insufficient_data')
"""


def _by_customer_year(spark, sf_dir):
    """Every row not fitted by a model, which SQL can follow."""
    methods = ["insufficient_data", "Trend Projection (limited data)", "Moving Average (due to zeros)"]
    return forecast.product_forecasts(customer_years(spark, sf_dir), methods=methods)


_add("forecast_by_customer_year", _by_customer_year, over_sales(PRODUCT_SQL + "SELECT * FROM allrows"))
_add(
    "forecast_ranking",
    lambda s, d: forecast.ranked_products(_by_customer_year(s, d)),
    over_sales(PRODUCT_SQL + "SELECT product, max(forecast_sum) AS forecast FROM allrows GROUP BY 1 HAVING coalesce(max(forecast_sum), 0) <> 0"),
)
_add(
    "forecast_top_product",
    lambda s, d: forecast.top_product(_by_customer_year(s, d)),
    over_sales(PRODUCT_SQL + """
SELECT product, max(forecast_sum) AS forecast FROM allrows GROUP BY 1 HAVING coalesce(max(forecast_sum), 0) <> 0 ORDER BY 2 DESC, 1 LIMIT 1"""),
)
_add(
    "forecast_chart_series",
    lambda s, d: forecast.forecast_chart_series(_by_customer_year(s, d)),
    over_sales(PRODUCT_SQL + "SELECT product, max(forecast_sum) AS forecast FROM allrows GROUP BY 1 HAVING max(forecast_sum) > 0"),
)
# The same over all products and methods; fitted models are beyond SQL.
_add("forecast_by_customer_year_all", lambda s, d: forecast.product_forecasts(customer_years(s, d)))
_add("forecast_chart_series_all", lambda s, d: forecast.forecast_chart_series(forecast.product_forecasts(customer_years(s, d))))
_add("forecast_ranking_all", lambda s, d: forecast.ranked_products(forecast.product_forecasts(customer_years(s, d))))
_add("forecast_top_product_all", lambda s, d: forecast.top_product(forecast.product_forecasts(customer_years(s, d))))
_add("forecast_trends_all", lambda s, d: forecast.forecast_trends(forecast.product_forecasts(customer_years(s, d))))
_add(
    "forecast_trends",
    lambda s, d: forecast.forecast_trends(_by_customer_year(s, d)),
    over_sales(PRODUCT_SQL + """
SELECT product, CASE WHEN count(step) < 2 THEN 'stable' WHEN arg_max(forecast, step) > arg_min(forecast, step) THEN 'increasing' ELSE 'decreasing' END AS trend
FROM allrows GROUP BY 1"""),
)
for _n in (3, 6):
    _label = (
        "'Q' || quarter(d + INTERVAL 1 MONTH) || ' ' || year(d + INTERVAL 1 MONTH)"
        if _n == 3
        else "strftime(d + INTERVAL 1 MONTH, '%b %Y') || ' - ' || strftime(d + INTERVAL 6 MONTH, '%b %Y')"
    )
    _add(
        f"forecast_horizon_{_n}_months",
        lambda s, d, _n=_n: forecast.forecast_horizon(sales(s, d, ["date"]), _n),
        f"""
WITH m AS (SELECT max(o_orderdate)::DATE AS d FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT {_label} AS period, CAST(i AS INTEGER) AS step, strftime(d + INTERVAL 1 MONTH * i, '%B %Y') AS month_name FROM m, range(1, {_n + 1}) r(i)""",
    )


# --- series with a closed form: what a model must give is known exactly


def _formed(spark, sf_dir, value):
    """One series per brand over its months; ``value`` makes a month's revenue of the brand's lines n and the month's place i.

    Half a unit is added, so that flooring a forecast does not depend on the last bit.
    """
    lines = sales(spark, sf_dir, ["date", "brand"]).where("date IS NOT NULL AND brand IS NOT NULL")
    month = F.trunc("date", "month")
    spans = lines.groupBy(F.col("brand").alias("series")).agg(F.min(month).alias("a"), F.max(month).alias("b"), F.count("*").alias("n"))
    listed = spans.select("series", "n", F.posexplode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("i", "month"))
    return listed.select("series", F.col("month").cast("date").alias("month"), (F.expr(value) + 0.5).cast("double").alias("revenue"))


_CONSTANT, _LINEAR, _SEASONAL = "n", "n + 3 * i", "n + 10 * month(month)"

_FORMED_SQL = """
, spans AS (SELECT brand AS series, date_trunc('month', min(date))::DATE AS a, date_trunc('month', max(date))::DATE AS b, count(*) AS n
            FROM sales WHERE date IS NOT NULL AND brand IS NOT NULL GROUP BY 1)
, ends AS (SELECT *, date_diff('month', a, b) + 1 AS len FROM spans)
, ahead AS (SELECT *, CAST(i AS INTEGER) AS step, CAST(b + INTERVAL 1 MONTH * i AS DATE) AS month FROM ends, range(1, 4) r(i) WHERE len >= 12)
"""


def _bounded_sql(value: str) -> str:
    return _FORMED_SQL + f"""
SELECT series, step, month, CAST({value} AS DOUBLE) AS forecast, CAST({value} AS DOUBLE) AS lower, CAST({value} AS DOUBLE) AS upper,
       CAST(0.95 AS DOUBLE) AS level, 'ARIMA (1,1,1)' AS method FROM ahead"""


_add("forecast_constant_series", lambda s, d: forecast.forecast_with_bounds(_formed(s, d, _CONSTANT)), over_sales(_bounded_sql("n")))
_add("forecast_linear_series", lambda s, d: forecast.forecast_with_bounds(_formed(s, d, _LINEAR)), over_sales(_bounded_sql("n + 3 * (len - 1 + i)")))
_add(
    "forecast_seasonal_series",
    lambda s, d: forecast.ensemble_forecast(_formed(s, d, _SEASONAL)).where("holt_winters IS NOT NULL").select("series", "step", "month", "holt_winters"),
    over_sales(_FORMED_SQL + "SELECT series, step, month, CAST(n + 10 * month(month) AS DOUBLE) AS holt_winters FROM ahead WHERE len >= 24"),
)
_add(
    "forecast_explained_linear_series",
    lambda s, d: forecast.explained_forecast(_formed(s, d, _LINEAR), steps=6).drop("explanation"),
    over_sales(_FORMED_SQL + """
SELECT series, 'increasing' AS trend_direction, (n + 3 * (len - 1) + 10.5 - (n + 3 * (len - 2) + 0.5)) / 6 AS avg_monthly_change,
       n + 3 * (len - 1) + CAST(0.5 AS DOUBLE) AS latest_revenue, 'ARIMA (1,1,1)' AS method FROM ends WHERE len >= 12"""),
)
_add(
    "forecast_steady_products",
    # The model branch: at least six months, none of them empty.
    lambda s, d: forecast.product_forecasts(_formed(s, d, _CONSTANT).select(F.col("series").alias("product"), F.col("month").alias("date"), "revenue")).where(
        "method = 'ARIMA (1,0,1)'"
    ),
    over_sales(_FORMED_SQL + """
, latest AS (SELECT max(b) AS lm FROM ends)
SELECT series AS product, CAST(i AS INTEGER) AS step, strftime(lm + INTERVAL 1 MONTH * i, '%B %Y') AS month_name, CAST(n AS DOUBLE) AS forecast,
       floor(3 * (n + 0.5)) AS forecast_sum, 'ARIMA (1,0,1)' AS method, len AS months_available FROM ends, latest, range(1, 4) r(i) WHERE len >= 6"""),
)
