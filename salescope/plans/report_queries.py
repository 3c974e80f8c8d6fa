"""Reports over the sales table and JSON-safe rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from salescope.functions.fixed_values import SECTIONS_BY_TYPE
from salescope.operators import reports
from salescope.plans.registry import Registry
from salescope.plans.sales_queries import _NUMBER, _OUTLIER_SQL, GROWTH_SQL, entity_months_sql
from salescope.plans.tables import over_sales, sales, table

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_OUTLIERS_ONLY = _OUTLIER_SQL[_OUTLIER_SQL.index(", judged"):]
_TRENDS_ONLY = entity_months_sql("customer", True)
BASE_SQL = GROWTH_SQL + _OUTLIERS_ONLY + """
, k AS (SELECT CAST(floor(SUM(revenue)) AS DOUBLE) AS r, CAST(floor(SUM(cost)) AS DOUBLE) AS c, floor(CAST(SUM(revenue) AS DOUBLE) / count(revenue)) AS o,
               CAST(floor(SUM(revenue) FILTER (payment_status = 'failed')) AS DOUBLE) AS failed,
               CAST(floor(SUM(revenue) FILTER (payment_status = 'pending')) AS DOUBLE) AS pending,
               count(*) FILTER (customer IS NULL) AS missing, count(*) AS n FROM sales)
, kpi AS (SELECT *, r - c AS p, floor((r - c) / r * 100) / 100 AS margin FROM k)
, by_customer AS (SELECT coalesce(customer, 'Unknown') AS label, CAST(floor(SUM(revenue)) AS DOUBLE) AS r FROM sales GROUP BY 1)
, by_product AS (SELECT coalesce(product, 'Unknown') AS label, CAST(floor(SUM(revenue)) AS DOUBLE) AS r FROM sales GROUP BY 1)
, by_region AS (SELECT coalesce(region, 'Unknown') AS label, CAST(floor(SUM(revenue)) AS DOUBLE) AS r FROM sales GROUP BY 1)
, by_status AS (SELECT payment_status AS label, CAST(floor(SUM(revenue)) AS DOUBLE) AS r FROM sales GROUP BY 1)
, top5 AS (SELECT * FROM by_customer ORDER BY r DESC, label LIMIT 5)
, texts AS (SELECT month, revenue, CASE kind WHEN 'spike' THEN 'Revenue spike detected: $' || RNUM || ' (vs average $' || ANUM || ')'
            ELSE 'Revenue dropped to $' || RNUM || ' (vs average $' || ANUM || ')' END AS text FROM found)
""".replace("RNUM", _NUMBER % "revenue").replace("ANUM", _NUMBER % "average")


def _n(expression: str) -> str:
    return _NUMBER % f"({expression})"


_SUMMARY_SQL = f"""
SELECT 'Total revenue: $' || {_n('r')} || ', total cost: $' || {_n('c')} || ', total profit: $' || {_n('p')} || ', profit margin: ' || {_n('margin * 100')} || '%.' || chr(10)
 || 'Top customers: ' || (SELECT string_agg(label || ' ($' || {_n('r')} || ')', ', ' ORDER BY r DESC, label) FROM (SELECT * FROM top5 ORDER BY r DESC, label LIMIT 3)) || '.' || chr(10)
 || (SELECT 'Latest month (' || strftime(month, '%B %Y') || ') growth: ' || CAST(round_even(growth * 100, 0) AS BIGINT) || '%.' || chr(10) FROM growth ORDER BY month DESC LIMIT 1)
 || CASE WHEN (SELECT count(*) FROM found) > 0 THEN 'Revenue anomalies detected.' || chr(10) ELSE '' END
 || CASE WHEN failed + pending > 0 THEN 'Outstanding unpaid revenue: $' || {_n('failed + pending')} || '.' || chr(10) ELSE '' END AS summary FROM kpi"""
_OVERVIEW_TEXT_SQL = f"""'Your business has generated $' || {_n('r')} || ' in revenue with a ' || format('{{:,.1f}}', margin * 100) || '% profit margin. '
 || 'Your top customer is ' || (SELECT label || ' contributing $' || {_n('r')} FROM top5 ORDER BY r DESC, label LIMIT 1) || '. '
 || 'The best-selling product is ' || (SELECT label || ' with $' || {_n('r')} FROM by_product ORDER BY r DESC, label LIMIT 1) || ' in revenue. '
 || CASE WHEN (SELECT count(*) FROM found) > 0 THEN 'We detected ' || (SELECT count(*) FROM found) || ' revenue anomalies that may need investigation.'
    ELSE 'No significant revenue anomalies were detected.' END"""

_add("summary_text", lambda s, d: reports.summary_text(sales(s, d)), over_sales(BASE_SQL + _SUMMARY_SQL))
_add(
    "overview",
    lambda s, d: reports.overview(sales(s, d)),
    over_sales(BASE_SQL + f"""
SELECT 'kpis' AS section, unnest(['total_revenue', 'total_cost', 'total_profit', 'profit_margin', 'avg_order_value']) AS key, unnest([r, c, p, margin, o]) AS value, CAST(NULL AS VARCHAR) AS text FROM kpi
UNION ALL SELECT 'top_customers', label, r, NULL FROM top5
UNION ALL (SELECT 'top_products', label, r, NULL FROM by_product ORDER BY r DESC, label LIMIT 5)
UNION ALL SELECT 'monthly_trend', CAST(last_day(month) AS VARCHAR), revenue, NULL FROM months
UNION ALL SELECT 'anomalies', CAST(month AS VARCHAR), revenue, text FROM texts
UNION ALL SELECT 'summary', 'text', NULL, {_OVERVIEW_TEXT_SQL} FROM kpi"""),
)
COMBINED_SQL = BASE_SQL + _TRENDS_ONLY + """
, g AS (SELECT month, growth, CASE WHEN growth <> 0 AND isfinite(growth) THEN growth END AS v FROM growth)
, gs AS (SELECT count(*) FILTER (v > 0) AS a, count(*) FILTER (v < 0) AS b, max(v) AS c, min(v) AS d, round(avg(v), 6) AS e, round_even(stddev_pop(v), 4) AS f,
                max(month) AS lm, arg_max(growth, month) AS lg FROM g)
, one AS (
SELECT unnest(['total_revenue', 'total_cost', 'total_profit', 'profit_margin', 'avg_order_value', 'failed_revenue', 'pending_revenue', 'revenue_at_risk',
               'revenue_at_risk_percentage', 'missing_customers', 'missing_customers_percentage', 'revenue_concentration']) AS section,
       unnest([r, c, p, margin, o, failed, pending, failed + pending, round_even((failed + pending) / r * 100, 1), CAST(missing AS DOUBLE),
               CASE WHEN missing > 0 THEN round_even(missing * 100 / n, 1) END, round_even((SELECT SUM(r) FROM top5) / r * 100, 1)]) AS value, CAST(NULL AS VARCHAR) AS text FROM kpi
UNION ALL SELECT unnest(['positive_growth_months', 'negative_growth_months', 'max_growth', 'min_growth', 'avg_growth', 'growth_volatility', 'latest_growth']),
       unnest([CAST(a AS DOUBLE), CAST(b AS DOUBLE), c, d, e, f, lg]), NULL FROM gs
UNION ALL SELECT 'latest_growth_month', NULL, CAST(lm AS VARCHAR) FROM gs
UNION ALL SELECT 'profit_trend', NULL, CASE WHEN count(*) >= 2 THEN CASE WHEN arg_max(profit, month) > arg_min(profit, month) THEN 'increasing' ELSE 'decreasing' END END FROM months
UNION ALL SELECT 'declining_customers_count', count(*), NULL FROM trends WHERE declining
UNION ALL SELECT 'anomaly_count', count(*), NULL FROM found)
, product_months AS (SELECT coalesce(product, 'Unknown') AS label, strftime(date, '%Y-%m') AS m, CAST(floor(SUM(revenue)) AS DOUBLE) AS r FROM sales
                     WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1, 2)
, customer_months AS (SELECT coalesce(customer, 'Unknown') AS label, strftime(date, '%Y-%m') AS m, CAST(floor(SUM(revenue)) AS DOUBLE) AS r FROM sales
                      WHERE date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1, 2)
, combined AS (
SELECT section, section AS key, value, text FROM one
UNION ALL SELECT 'monthly_growth', CAST(month AS VARCHAR), growth, NULL FROM growth
UNION ALL SELECT 'monthly_profit', CAST(last_day(month) AS VARCHAR), profit, NULL FROM months
UNION ALL SELECT 'revenue_by_product', label, r, NULL FROM by_product
UNION ALL SELECT 'revenue_by_product_raw', label, r, NULL FROM by_product
UNION ALL SELECT 'revenue_by_customer_raw', label, r, NULL FROM by_customer
UNION ALL SELECT unnest(['product_monthly_trends', 'monthly_revenue_by_product_raw']), unnest([label || '_monthly_trend', label]), r, m FROM product_months
UNION ALL SELECT 'customer_monthly_trends', label, r, m FROM customer_months
UNION ALL SELECT 'declining_customers', customer, NULL, NULL FROM trends WHERE declining
UNION ALL SELECT 'revenue_by_region', label, r, NULL FROM by_region
UNION ALL SELECT 'top_regions', label, r, NULL FROM by_region
UNION ALL SELECT 'top_customers', label, r, NULL FROM top5
UNION ALL SELECT 'payment_status_counts', label, r, NULL FROM by_status
UNION ALL SELECT 'anomalies', CAST(month AS VARCHAR), revenue, text FROM texts)
"""


_add("combined_metrics", lambda s, d: reports.combined_metrics(sales(s, d)), over_sales(COMBINED_SQL + "SELECT * FROM combined"))
for _type in ("risk", "performance", "revenue_analysis"):
    _listed = ", ".join(f"'{x}'" for x in SECTIONS_BY_TYPE[_type])
    _add(
        f"sections_for_{_type}",
        lambda s, d, _type=_type: reports.sections_for(sales(s, d), _type),
        over_sales(COMBINED_SQL + f"SELECT * FROM combined WHERE section IN ({_listed})"),
    )
# Models are beyond SQL; every section of the list must occur.
_add("sections_for_forecast", lambda s, d: reports.sections_for(sales(s, d), "forecast"))
_add(
    "registry_run",
    lambda s, d: Registry().run("detect_revenue_spikes", sales(s, d), threshold_std=1, by_product=False).select("month", "kind", "revenue"),
    over_sales(_OUTLIER_SQL.replace("2 * dev", "1 * dev") + "SELECT month, kind, revenue FROM found"),
)


def _odd_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "view", float("nan")).when(F.col("event_type") == "click", float("inf")).otherwise(F.col("value"))
    return events.select(
        "event_id", "ts", F.col("ts").cast("date").alias("day"), value.alias("value"),
        F.struct(value.alias("inner"), F.array(value, F.lit(1.5)).alias("list")).alias("nested"),
    )


def _read_back(spark, sf_dir):
    def at(path: str):
        return F.get_json_object("json", path)

    return reports.json_rows(_odd_rows(spark, sf_dir)).select(
        at("$.event_id").cast("long").alias("event_id"), at("$.ts").alias("ts"), at("$.day").alias("day"),
        at("$.value").cast("double").alias("value"), at("$.nested.inner").cast("double").alias("inner"),
        at("$.nested.list[0]").try_cast("double").alias("first"), at("$.nested.list[1]").cast("double").alias("second"),
    )


_add(
    "json_safe_rows",
    _read_back,
    """
WITH e AS (SELECT event_id, ts, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
       strftime(ts, '%Y-%m-%d') AS day, v AS value, v AS inner, v AS first, CAST(1.5 AS DOUBLE) AS second FROM e""",
)
