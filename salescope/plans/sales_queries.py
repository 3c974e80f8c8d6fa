"""Aggregates, series, anomalies and seasonality over the sales table."""

from __future__ import annotations

from pyspark.sql import functions as F

from salescope.functions.text import display_name
from salescope.operators import aggregates as agg
from salescope.operators import anomalies, timeseries
from salescope.plans.tables import over_sales, sales

QUERIES = {}
ORACLES = {}


def _add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


MONTHS_SQL = """
, sums AS (SELECT date_trunc('month', date)::DATE AS month, SUM(revenue) AS revenue, SUM(profit) AS profit
           FROM sales WHERE date IS NOT NULL GROUP BY 1)
, spine AS (SELECT unnest(generate_series((SELECT min(month) FROM sums)::TIMESTAMP, (SELECT max(month) FROM sums)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month)
, months AS (SELECT spine.month, CAST(floor(coalesce(revenue, 0)) AS DOUBLE) AS revenue,
                    CAST(floor(coalesce(profit, 0)) AS DOUBLE) AS profit
             FROM spine LEFT JOIN sums USING (month))
"""
GROWTH_SQL = MONTHS_SQL + """
, moved AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS before FROM months)
, growth AS (SELECT last_day(month) AS month,
               CASE WHEN before IS NULL OR (before = 0 AND revenue = 0) THEN 0.0
                    WHEN before = 0 THEN sign(revenue) * 'Infinity'::DOUBLE
                    ELSE floor((revenue / before - 1) * 100) / 100 END AS growth
             FROM moved WHERE (SELECT count(*) FROM months) >= 2)
"""


def entity_months_sql(entity: str, unknown: bool) -> str:
    label = f"CASE WHEN {entity} IS NULL OR {entity} = '' THEN 'Unknown' ELSE {entity} END" if unknown else entity
    return f"""
, em AS (SELECT {label} AS {entity}, date_trunc('month', date)::DATE AS month,
                CAST(floor(SUM(revenue)) AS DOUBLE) AS revenue
         FROM sales WHERE date IS NOT NULL AND revenue IS NOT NULL AND {label} IS NOT NULL GROUP BY 1, 2)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY month DESC) AS back,
                    lead(revenue) OVER (PARTITION BY {entity} ORDER BY month) AS later FROM em)
, trends AS (SELECT {entity}, count(*) AS n_months, SUM(revenue) AS total_revenue,
                string_agg(CASE WHEN back <= 6 THEN CAST(CAST(revenue AS BIGINT) AS VARCHAR) END, ',' ORDER BY month) AS trend,
                count(*) >= 2 AND coalesce(bool_and(CASE WHEN back BETWEEN 2 AND 6 THEN revenue >= later END), true) AS declining
             FROM ranked GROUP BY 1)
"""


# --- key figures and breakdowns -------------------------------------------------
_add(
    "kpis",
    lambda s, d: agg.kpis(sales(s, d, ["revenue", "cost"])),
    over_sales("""
, t AS (SELECT CAST(floor(SUM(revenue)) AS DOUBLE) AS r, CAST(floor(SUM(cost)) AS DOUBLE) AS c,
               floor(CAST(SUM(revenue) AS DOUBLE) / count(revenue)) AS o FROM sales)
SELECT r AS total_revenue, c AS total_cost, r - c AS total_profit,
       CASE WHEN r > 0 THEN floor((r - c) / r * 100) / 100 ELSE 0 END AS profit_margin, o AS avg_order_value FROM t"""),
)
_add(
    "kpis_from_similar_names",
    lambda s, d: agg.kpis_from_similar_names(
        sales(s, d, ["revenue", "customer"]).withColumnRenamed("revenue", "net_sales_amount")
    ),
    over_sales("""
, t AS (SELECT CAST(floor(SUM(revenue)) AS DOUBLE) AS r, floor(CAST(SUM(revenue) AS DOUBLE) / count(revenue)) AS o FROM sales)
SELECT r AS total_revenue, floor(r * 0.6::DOUBLE) AS total_cost, r - floor(r * 0.6::DOUBLE) AS total_profit,
       CAST(0.4 AS DOUBLE) AS profit_margin, o AS avg_order_value, true AS cost_estimated FROM t"""),
)
for _dim in ("customer", "product", "region"):
    _add(
        f"revenue_by_{_dim}",
        lambda s, d, _dim=_dim: agg.revenue_by(sales(s, d, [_dim, "revenue"]), _dim),
        over_sales(f"""
SELECT CASE WHEN {_dim} IS NULL OR {_dim} = '' THEN 'Unknown' ELSE {_dim} END AS {_dim},
       CAST(floor(SUM(revenue)) AS DOUBLE) AS revenue FROM sales GROUP BY 1"""),
    )
_add(
    "revenue_by_payment_status",
    lambda s, d: agg.revenue_by_payment_status(sales(s, d, ["payment_status", "revenue"])),
    over_sales("""
SELECT coalesce(payment_status, 'unknown') AS payment_status, CAST(floor(SUM(revenue)) AS DOUBLE) AS revenue
FROM sales GROUP BY 1"""),
)
_add(
    "total_units",
    lambda s, d: agg.total_units(sales(s, d, ["quantity"])),
    "SELECT floor(SUM(l_quantity)) AS total_units FROM lineitem",
)
_add(
    "revenue_per_unit",
    lambda s, d: agg.revenue_per_unit(sales(s, d, ["revenue", "quantity"])),
    over_sales(" SELECT floor(CAST(SUM(revenue) AS DOUBLE) / nullif(SUM(quantity), 0)) AS revenue_per_unit FROM sales"),
)
for _dim, _n in (("customer", 5), ("region", 5), ("product", 3)):
    _add(
        f"top_{_dim}s",
        lambda s, d, _dim=_dim, _n=_n: agg.top_by_revenue(sales(s, d, [_dim, "revenue"]), _dim, _n),
        over_sales(f"""
SELECT coalesce({_dim}, 'Unknown') AS {_dim}, CAST(floor(SUM(revenue)) AS DOUBLE) AS revenue
FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_n}"""),
    )
_add(
    "revenue_concentration",
    lambda s, d: agg.revenue_concentration(sales(s, d, ["customer", "revenue"])),
    over_sales("""
, top AS (SELECT coalesce(customer, 'Unknown') AS c, CAST(floor(SUM(revenue)) AS DOUBLE) AS r
          FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
, t AS (SELECT SUM(r) AS top_revenue, (SELECT CAST(floor(SUM(revenue)) AS DOUBLE) FROM sales) AS total_revenue FROM top)
SELECT *, round_even(top_revenue / total_revenue * 100, 1) AS concentration_pct FROM t"""),
)
RISK_SQL = """
, t AS (SELECT CAST(floor(coalesce(SUM(revenue) FILTER (payment_status = 'failed'), 0)) AS DOUBLE) AS failed_revenue,
               CAST(floor(coalesce(SUM(revenue) FILTER (payment_status = 'pending'), 0)) AS DOUBLE) AS pending_revenue,
               CAST(floor(SUM(revenue)) AS DOUBLE) AS total FROM sales)
"""
_add(
    "revenue_at_risk",
    lambda s, d: agg.revenue_at_risk(sales(s, d, ["payment_status", "revenue"])),
    over_sales(RISK_SQL + """
SELECT failed_revenue, pending_revenue, failed_revenue + pending_revenue AS revenue_at_risk,
       round_even((failed_revenue + pending_revenue) / total * 100, 1) AS at_risk_pct FROM t"""),
)
_add(
    "outstanding_revenue",
    lambda s, d: agg.outstanding_revenue(sales(s, d, ["payment_status", "revenue"])),
    over_sales(RISK_SQL + "SELECT failed_revenue + pending_revenue AS outstanding_revenue FROM t"),
)
_add(
    "paid_revenue_by_month_and_region",
    lambda s, d: agg.paid_revenue_by_month_and_region(sales(s, d, ["date", "region", "revenue", "payment_status"])),
    over_sales("""
SELECT date_trunc('month', date)::DATE AS month, region, CAST(SUM(revenue) AS DOUBLE) AS total_revenue,
       count(*) AS transaction_count, CAST(SUM(revenue) AS DOUBLE) / count(revenue) AS avg_transaction_value
FROM sales WHERE payment_status = 'paid' GROUP BY 1, 2"""),
)
_add(
    "customer_lifetime_value",
    lambda s, d: agg.customer_lifetime_value(sales(s, d, ["date", "customer", "revenue", "payment_status"])),
    over_sales("""
SELECT customer, count(*) AS purchase_count, CAST(SUM(revenue) AS DOUBLE) AS total_spent,
       CAST(SUM(revenue) AS DOUBLE) / count(revenue) AS avg_purchase_value,
       min(date) AS first_purchase, max(date) AS last_purchase
FROM sales WHERE payment_status = 'paid' AND customer IS NOT NULL GROUP BY 1"""),
)
_add(
    "product_trend_profile",
    lambda s, d: agg.trend_profile(
        timeseries.entity_months(sales(s, d, ["date", "brand", "revenue"]).withColumnRenamed("brand", "product"), "product")
    ).withColumn("avg_revenue", F.round("avg_revenue", 4)),
    over_sales(entity_months_sql("brand", False) + """
SELECT brand AS product, SUM(revenue) AS total_revenue, round(AVG(revenue), 4) AS avg_revenue,
       max(revenue) AS best_revenue, arg_max(month, struct_pack(r := revenue, d := -(month - DATE '1970-01-01'))) AS best_month,
       min(revenue) AS worst_revenue, arg_min(month, struct_pack(r := revenue, d := month - DATE '1970-01-01')) AS worst_month
FROM em GROUP BY 1 HAVING SUM(revenue) > 0"""),
)

# --- monthly series ---------------------------------------------------------------
_add(
    "monthly_revenue",
    lambda s, d: timeseries.monthly_revenue(sales(s, d, ["date", "revenue"])),
    over_sales(MONTHS_SQL + "SELECT last_day(month) AS month, revenue FROM months"),
)
_add(
    "monthly_profit",
    lambda s, d: timeseries.monthly_profit(sales(s, d, ["date", "profit"])),
    over_sales(MONTHS_SQL + "SELECT last_day(month) AS month, profit FROM months"),
)
_add(
    "monthly_growth",
    lambda s, d: timeseries.monthly_growth(sales(s, d, ["date", "revenue"])),
    over_sales(GROWTH_SQL + "SELECT month, growth FROM growth"),
)
_add(
    "growth_stats",
    lambda s, d: timeseries.growth_stats(timeseries.monthly_growth(sales(s, d, ["date", "revenue"]))),
    over_sales(GROWTH_SQL + """
, g AS (SELECT month, growth, CASE WHEN growth <> 0 AND isfinite(growth) THEN growth END AS v FROM growth)
SELECT count(*) FILTER (v > 0) AS positive_growth_months, count(*) FILTER (v < 0) AS negative_growth_months,
       max(v) AS max_growth, min(v) AS min_growth, round(avg(v), 6) AS avg_growth,
       round_even(stddev_pop(v), 4) AS growth_volatility, max(month) AS latest_month, arg_max(growth, month) AS latest_growth
FROM g"""),
)
_add(
    "profit_trend",
    lambda s, d: timeseries.profit_trend(timeseries.monthly_profit(sales(s, d, ["date", "profit"]))),
    over_sales(MONTHS_SQL + """
SELECT arg_min(profit, month) AS first_profit, arg_max(profit, month) AS last_profit,
       CASE WHEN count(*) < 2 THEN NULL WHEN arg_max(profit, month) > arg_min(profit, month) THEN 'increasing' ELSE 'decreasing' END AS trend
FROM months"""),
)


def _flat(trends, entity):
    """Trend rows with the nested columns as text, for comparison by value."""
    as_text = F.array_join(F.transform("trend", lambda v: v.cast("long").cast("string")), ",")
    return trends.select(
        entity, F.size("monthly_revenue").cast("long").alias("n_months"), "total_revenue", as_text.alias("trend"), "declining"
    )


_add(
    "monthly_revenue_by_product",
    lambda s, d: _flat(timeseries.monthly_revenue_by_product(sales(s, d, ["date", "product", "revenue"])), "product"),
    over_sales(entity_months_sql("product", False) + "SELECT * FROM trends"),
)
_add(
    "monthly_revenue_by_customer",
    lambda s, d: _flat(timeseries.monthly_revenue_by_customer(sales(s, d, ["date", "customer", "revenue"])), "customer"),
    over_sales(entity_months_sql("customer", True) + "SELECT * FROM trends"),
)
_add(
    "declining_customers",
    lambda s, d: timeseries.declining_customers(sales(s, d, ["date", "customer", "revenue"])),
    over_sales(entity_months_sql("customer", True) + "SELECT customer FROM trends WHERE declining"),
)
_add(
    "declining_customer_count",
    lambda s, d: timeseries.declining_customers(sales(s, d, ["date", "customer", "revenue"])).agg(
        F.count("*").alias("declining_customers")
    ),
    over_sales(entity_months_sql("customer", True) + "SELECT count(*) AS declining_customers FROM trends WHERE declining"),
)
_add(
    "product_month_table",
    lambda s, d: timeseries.product_month_table(sales(s, d, ["date", "product", "revenue"])),
    over_sales("""
SELECT product, date_trunc('month', date)::DATE AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       strftime(date_trunc('month', date), '%Y-%m') AS month_text
FROM sales WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY ALL"""),
)
_add(
    "sparse_months_by_brand",
    lambda s, d: timeseries.sparse_months(sales(s, d, ["date", "brand", "revenue"]), keys=["brand"]).withColumn(
        "revenue", F.col("revenue").cast("double")
    ),
    over_sales("""
SELECT brand, date_trunc('month', date)::DATE AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
FROM sales WHERE date IS NOT NULL GROUP BY 1, 2"""),
)
_add(
    "interpolated_months",
    # Every quarter's last month is withheld and filled from its neighbours.
    lambda s, d: timeseries.interpolate_months(
        timeseries.sparse_months(sales(s, d, ["date", "brand", "revenue"]), keys=["brand"]).withColumn(
            "revenue", F.when(F.month("month") % 3 != 0, F.col("revenue"))
        ),
        keys=["brand"],
    ).withColumn("revenue", F.round("revenue", 4)),
    over_sales("""
, m AS (SELECT brand, date_trunc('month', date)::DATE AS month,
               CASE WHEN month(date_trunc('month', date)) % 3 <> 0 THEN CAST(SUM(revenue) AS DOUBLE) END AS v
        FROM sales WHERE date IS NOT NULL GROUP BY brand, date_trunc('month', date))
, b AS (SELECT brand, month, v,
          last_value(v IGNORE NULLS) OVER past AS v0, last_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER past AS d0,
          first_value(v IGNORE NULLS) OVER ahead AS v1, first_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER ahead AS d1
        FROM m WINDOW past AS (PARTITION BY brand ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      ahead AS (PARTITION BY brand ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT brand, month, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
       ELSE v0 + (v1 - v0) * (CAST(month - d0 AS DOUBLE) / (d1 - d0)) END, 4) AS revenue FROM b"""),
)
_add(
    "display_names",
    lambda s, d: sales(s, d, ["product"])
    .select(F.concat(F.initcap("product"), F.lit("_Plan")).alias("name"))
    .groupBy("name")
    .agg(F.count("*").alias("rows"))
    .select(display_name(F.col("name")).alias("name"), "rows"),
    """
SELECT upper(p_type[1]) || lower(p_type[2:]) || ' Plan' AS name, count(*) AS rows
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)

# --- anomalies and seasonality -----------------------------------------------------
_NUMBER = "format('{:,}', CAST(round_even(%s, 0) AS BIGINT))"
_OUTLIER_SQL = MONTHS_SQL + """
, judged AS (SELECT last_day(month) AS month, revenue, avg(revenue) OVER () AS average,
                    stddev_samp(revenue) OVER () AS dev, count(*) OVER () AS n FROM months)
, found AS (SELECT *, CASE WHEN revenue > average + 2 * dev THEN 'spike' ELSE 'drop' END AS kind FROM judged
            WHERE n >= 3 AND (revenue > average + 2 * dev OR revenue < average - 2 * dev))
"""
_add(
    "revenue_anomalies",
    lambda s, d: anomalies.revenue_anomalies(sales(s, d, ["date", "revenue"])),
    over_sales(_OUTLIER_SQL + f"""
SELECT month, kind, revenue, round(average, 6) AS average,
       CASE kind WHEN 'spike' THEN 'Revenue spike detected: $' || {_NUMBER % 'revenue'} || ' (vs average $' || {_NUMBER % 'average'} || ')'
       ELSE 'Revenue dropped to $' || {_NUMBER % 'revenue'} || ' (vs average $' || {_NUMBER % 'average'} || ')' END AS text
FROM found"""),
)
_add(
    "anomaly_count",
    lambda s, d: anomalies.anomaly_count(sales(s, d, ["date", "revenue"])),
    over_sales(_OUTLIER_SQL + "SELECT count(*) AS anomaly_count FROM found"),
)
_add(
    "product_anomalies",
    lambda s, d: anomalies.product_anomalies(sales(s, d, ["date", "product", "revenue"])),
    over_sales(f"""
, m AS (SELECT product, date_trunc('month', date)::DATE AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue
        FROM sales WHERE date IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2)
, judged AS (SELECT *, avg(revenue) OVER w AS average, stddev_samp(revenue) OVER w AS dev, count(*) OVER w AS n
             FROM m WINDOW w AS (PARTITION BY product))
, found AS (SELECT *, CASE WHEN revenue > average + 2 * dev THEN 'spike' ELSE 'drop' END AS kind FROM judged
            WHERE n >= 3 AND (revenue > average + 2 * dev OR revenue < average - 2 * dev))
SELECT product, month, kind, revenue, round(average, 6) AS average,
  CASE kind WHEN 'spike' THEN 'The revenue was $' || {_NUMBER % 'revenue'} || ', which is significantly higher than the average of $' || {_NUMBER % 'average'} || ' for ' || product
  ELSE 'The revenue dropped significantly to $' || {_NUMBER % 'revenue'} || ', which is much lower than the average of $' || {_NUMBER % 'average'} || ' for ' || product END AS text
FROM found"""),
)
_SEASON_SQL = MONTHS_SQL + """
, smooth AS (SELECT month, month(month) AS cm, revenue,
    CASE WHEN row_number() OVER (ORDER BY month) > 6 AND count(*) OVER () - row_number() OVER (ORDER BY month) >= 6
         THEN (sum(revenue) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
             + sum(revenue) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24 END AS trend FROM months)
, typical AS (SELECT cm, avg(revenue - trend) AS t FROM smooth GROUP BY 1)
, centred AS (SELECT cm, t - (SELECT avg(t) FROM typical) AS seasonal FROM typical)
, parts AS (SELECT month, smooth.cm, seasonal, revenue - trend - seasonal AS residual FROM smooth JOIN centred USING (cm))
"""
_add(
    "seasonal_pattern",
    lambda s, d: anomalies.seasonal_pattern(sales(s, d, ["date", "revenue"])),
    over_sales(_SEASON_SQL + "SELECT CAST(cm AS INTEGER) AS calendar_month, round(seasonal, 4) AS effect FROM centred"),
)
_add(
    "seasonality",
    lambda s, d: anomalies.seasonality(sales(s, d, ["date", "revenue"])),
    over_sales(_SEASON_SQL + """
, st AS (SELECT count(*) AS months_available, 1 - var_samp(residual) / var_samp(seasonal) AS strength FROM parts)
, named AS (SELECT *, months_available >= 24 AND strength > 0.3 AS s,
    (SELECT strftime(make_date(2024, CAST(cm AS INTEGER), 1), '%B') FROM centred ORDER BY seasonal DESC, cm LIMIT 1) AS peak,
    (SELECT strftime(make_date(2024, CAST(cm AS INTEGER), 1), '%B') FROM centred ORDER BY seasonal, cm LIMIT 1) AS trough FROM st)
SELECT s AS has_seasonality, months_available, CASE WHEN months_available >= 24 THEN round_even(strength, 2) END AS strength,
       CASE WHEN s THEN peak END AS peak_month, CASE WHEN s THEN trough END AS trough_month,
       CASE WHEN months_available < 24 THEN 'Insufficient data for seasonality detection (need at least 24 months)'
            WHEN NOT s THEN 'No strong seasonal pattern detected'
            ELSE 'Strong seasonal pattern detected. Revenue typically peaks in ' || peak || ' and troughs in ' || trough || '.' END AS message
FROM named"""),
)
