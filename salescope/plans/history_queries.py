"""History, stored results and their extraction, on tables derived from orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from salescope.operators import extraction, history
from salescope.plans.tables import over_sales, sales, table
from salescope.session import spread

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def analyses(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "file").when(F.col("o_orderstatus") == "P", "database").otherwise("google_sheets").alias("analysis_type"),
        F.concat(F.lit("Orders of priority "), "o_orderpriority").alias("question"),
        F.col("o_orderdate").alias("created_at"),
        F.lit("completed").alias("status"),
        F.lit("{}").alias("data_source"),
    )


def _line(spark, sf_dir, *numbers):
    return table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").isin(*numbers))


def metrics(spark, sf_dir):
    n = F.col("l_linenumber")
    return _line(spark, sf_dir, 1, 2, 3, 4).select(
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("metric_id"),
        F.col("l_orderkey").alias("analysis_id"),
        F.when(n == 1, "total_revenue").when(n == 2, "profit_margin").when(n == 3, "revenue").otherwise("monthly_revenue").alias("metric_type"),
        F.col("l_extendedprice").cast("decimal(20,2)").alias("metric_value"),
        F.when(n == 4, F.col("l_shipdate").cast("date")).alias("metric_date"),
        F.when(n == 3, "product").when(n == 4, "time_series").alias("category"),
        F.when(n == 3, F.col("l_returnflag")).when(n == 4, "monthly").alias("category_name"),
    )


def insights(spark, sf_dir):
    return _line(spark, sf_dir, 5, 6).select(
        F.col("l_orderkey").alias("analysis_id"),
        F.when(F.col("l_linenumber") == 5, "answer").otherwise("anomaly").alias("insight_type"),
        F.concat(F.lit("Flag "), "l_returnflag").alias("insight_text"),
        F.col("l_discount").cast("decimal(5,2)").alias("confidence_score"),
    )


def charts(spark, sf_dir):
    return _line(spark, sf_dir, 7).select(
        F.col("l_orderkey").alias("analysis_id"),
        F.lit("monthly_growth").alias("chart_type"),
        F.concat(F.lit("/srv/charts/"), F.col("l_suppkey").cast("string"), F.lit(".png")).alias("chart_path"),
        F.lit(None).cast("string").alias("chart_data"),
    )


HISTORY_SQL = """
WITH history AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'file' WHEN 'P' THEN 'database' ELSE 'google_sheets' END AS analysis_type,
                        'Orders of priority ' || o_orderpriority AS question, o_orderdate AS created_at, '{}' AS data_source FROM orders)
, metrics AS (SELECT l_partkey * 100000 + l_suppkey AS metric_id, l_orderkey AS analysis_id,
    CASE l_linenumber WHEN 1 THEN 'total_revenue' WHEN 2 THEN 'profit_margin' WHEN 3 THEN 'revenue' ELSE 'monthly_revenue' END AS metric_type,
    CAST(l_extendedprice AS DECIMAL(20,2)) AS metric_value, CASE WHEN l_linenumber = 4 THEN l_shipdate::DATE END AS metric_date,
    CASE l_linenumber WHEN 3 THEN 'product' WHEN 4 THEN 'time_series' END AS category,
    CASE l_linenumber WHEN 3 THEN l_returnflag WHEN 4 THEN 'monthly' END AS category_name FROM lineitem WHERE l_linenumber <= 4)
, insights AS (SELECT l_orderkey AS analysis_id, CASE l_linenumber WHEN 5 THEN 'answer' ELSE 'anomaly' END AS insight_type,
    'Flag ' || l_returnflag AS insight_text, CAST(l_discount AS DECIMAL(5,2)) AS confidence_score FROM lineitem WHERE l_linenumber IN (5, 6))
, charts AS (SELECT l_orderkey AS analysis_id, 'monthly_growth' AS chart_type, '/srv/charts/' || l_suppkey || '.png' AS chart_path FROM lineitem WHERE l_linenumber = 7)
"""
_add(
    "history_page",
    lambda s, d: history.history_page(analyses(s, d), metrics(s, d), insights(s, d), limit=20, offset=10),
    HISTORY_SQL + """
, page AS (SELECT * FROM history ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10)
SELECT id AS analysis_id, analysis_type, question, created_at, data_source,
  (SELECT CAST(metric_value AS DOUBLE) FROM metrics m WHERE m.analysis_id = page.id AND metric_type = 'total_revenue' ORDER BY metric_id, metric_value LIMIT 1) AS total_revenue,
  (SELECT CAST(metric_value AS DOUBLE) FROM metrics m WHERE m.analysis_id = page.id AND metric_type = 'profit_margin' ORDER BY metric_id, metric_value LIMIT 1) AS profit_margin,
  (SELECT count(*) FROM insights i WHERE i.analysis_id = page.id) AS insight_count, (SELECT count(*) FROM history) AS total FROM page""",
)
_add(
    "analysis_details",
    lambda s, d: history.analysis_detail(analyses(s, d), metrics(s, d), insights(s, d), charts(s, d)),
    HISTORY_SQL + """
SELECT analysis_id, 'metrics' AS section, coalesce(category, 'general') AS grp, concat_ws('/', metric_type, category_name) AS label,
       CAST(metric_value AS DOUBLE) AS value, CAST(metric_date AS VARCHAR) AS text FROM metrics
UNION ALL SELECT analysis_id, 'insights', insight_type, NULL, CAST(confidence_score AS DOUBLE), insight_text FROM insights
UNION ALL SELECT analysis_id, 'charts', chart_type, chart_path, NULL, NULL FROM charts""",
)
_add(
    "metrics_of_type",
    lambda s, d: history.owned_metrics(metrics(s, d), analyses(s, d), metric_type="revenue", category="product").select(
        "analysis_id", "category_name", F.col("metric_value").cast("double").alias("metric_value")
    ),
    HISTORY_SQL + """
SELECT analysis_id, category_name, CAST(metric_value AS DOUBLE) AS metric_value FROM metrics
WHERE metric_type = 'revenue' AND category = 'product' AND analysis_id IN (SELECT id FROM history)""",
)
_add(
    "insights_of_type",
    lambda s, d: history.owned_insights(insights(s, d), analyses(s, d), insight_type="anomaly").select(
        "analysis_id", "insight_text", F.col("confidence_score").cast("double").alias("confidence_score")
    ),
    HISTORY_SQL + """
SELECT analysis_id, insight_text, CAST(confidence_score AS DOUBLE) AS confidence_score FROM insights
WHERE insight_type = 'anomaly' AND analysis_id IN (SELECT id FROM history)""",
)
_add(
    "charts_with_links",
    lambda s, d: history.charts_with_links(charts(s, d), analyses(s, d)).select("analysis_id", "chart_type", "file_name", "url"),
    HISTORY_SQL + """
SELECT analysis_id, chart_type, split_part(chart_path, '/', -1) AS file_name, '/api/v1/analysis/chart/' || split_part(chart_path, '/', -1) AS url FROM charts""",
)


def _after_deletion(spark, sf_dir):
    """Row counts once every failed analysis and its children are gone."""
    tables = {
        "history": analyses(spark, sf_dir), "metrics": metrics(spark, sf_dir),
        "insights": insights(spark, sf_dir), "charts": charts(spark, sf_dir),
    }
    doomed = tables["history"].where(F.col("analysis_type") == "google_sheets").select(F.col("id").alias("analysis_id"))
    left = history.without_analyses(tables, doomed)
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_add(
    "analyses_deleted",
    _after_deletion,
    HISTORY_SQL + """
, doomed AS (SELECT id FROM history WHERE analysis_type = 'google_sheets')
SELECT 'history' AS "table", count(*) AS rows FROM history WHERE id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'metrics', count(*) FROM metrics WHERE analysis_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'insights', count(*) FROM insights WHERE analysis_id NOT IN (SELECT id FROM doomed)
UNION ALL SELECT 'charts', count(*) FROM charts WHERE analysis_id NOT IN (SELECT id FROM doomed)""",
)
_NOW = "2000-11-01"  # analyses go on after it
_DAILY_SQL = HISTORY_SQL + """
, daily AS (SELECT coalesce(metric_date, created_at::DATE) AS day, round(CAST(SUM(metric_value) AS DOUBLE) / count(metric_value), 6) AS value
            FROM metrics JOIN history ON analysis_id = id
            WHERE metric_type = 'KIND' AND created_at >= TIMESTAMP 'AS_OF' - INTERVAL 400 DAY AND created_at <= TIMESTAMP 'AS_OF' GROUP BY 1)
""".replace("AS_OF", _NOW)
for _kind in ("total_revenue", "monthly_revenue"):
    _add(
        f"daily_{_kind}_of_analyses",
        lambda s, d, _kind=_kind: history.metric_by_day(metrics(s, d), analyses(s, d), _kind, _NOW, 400),
        _DAILY_SQL.replace("KIND", _kind) + "SELECT * FROM daily",
    )
_add(
    "metric_trend",
    lambda s, d: history.metric_trend(history.metric_by_day(metrics(s, d), analyses(s, d), "total_revenue", _NOW, 400)),
    _DAILY_SQL.replace("KIND", "total_revenue") + """
, ends AS (SELECT count(*) AS days, arg_min(value, day) AS a, arg_max(value, day) AS b FROM daily)
SELECT days, CASE WHEN days >= 2 AND a > 0 THEN CASE WHEN b > a THEN 'up' ELSE 'down' END END AS direction,
       CASE WHEN days >= 2 AND a > 0 THEN round_even((b - a) / a * 100, 1) END AS percent_change FROM ends""",
)


# --- extraction from stored JSON ---------------------------------------------------


def stored_results(spark, sf_dir):
    """One result document per customer: figures, breakdown by brand, months, insights."""
    lines = sales(spark, sf_dir, ["date", "customer", "brand", "revenue"]).where(F.col("customer").isNotNull())
    cell = lines.groupBy("customer", "brand").agg(F.sum("revenue").alias("r"), F.count("*").alias("n"))
    nested = F.concat(F.lit('{"total_revenue": '), F.col("r").cast("string"), F.lit(', "trend": [1]}'))
    shown = F.when(F.col("n") > 1, nested).otherwise(F.col("r").cast("string"))
    item = F.concat(F.lit('"'), "brand", F.lit('": '), shown)
    cell = spread(cell, table(spark, sf_dir, "lineitem").count(), "customer")
    docs = cell.groupBy("customer").agg(
        F.sum("r").alias("total"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("brands")
    )
    figures = F.concat(F.lit('{"total_revenue": '), F.col("total").cast("string"), F.lit(', "total_transactions": '), F.col("n").cast("string"), F.lit("}"))
    key = F.when(F.col("n") % 2 == 0, "kpis").otherwise("compute_kpis")
    raw = F.concat(
        F.lit('{"'), key, F.lit('": '), figures, F.lit(', "revenue_by_product": {'), F.col("brands"),
        F.lit('}, "monthly_trend": {"2024-01": 5, "Feb 2024": '), F.col("n").cast("string"), F.lit(', "someday": 7}}'),
    )
    said = F.concat(
        F.lit('{"answer": "Spent '), F.col("total").cast("string"), F.lit('", "human_readable_summary": "S", "confidence_score": 0.6, '),
        F.lit('"anomalies": {"Overall": {"May": "high", "June": ""}, "Note": "odd", "More": ["a", "b"]}, '),
        F.lit('"recommended_metrics": {"next_step": "call", "others": ["x", "y"]}}'),
    )
    return docs.select(
        F.regexp_extract("customer", "([0-9]+)", 1).cast("long").alias("id"),
        F.when(F.col("n") % 7 == 0, F.lit("not json")).otherwise(raw).alias("raw_results"),
        said.alias("insights_json"),
    )


STORED_SQL = """
, cell AS (SELECT CAST(regexp_extract(customer, '([0-9]+)', 1) AS BIGINT) AS analysis_id, brand, SUM(revenue) AS r, count(*) AS n
           FROM sales WHERE customer IS NOT NULL GROUP BY 1, 2)
, docs AS (SELECT analysis_id, SUM(r) AS total, CAST(SUM(n) AS BIGINT) AS n FROM cell GROUP BY 1)
, good AS (SELECT * FROM docs WHERE n % 7 <> 0)
"""
_EXTRACTED_SQL = STORED_SQL + """
, extracted AS (
SELECT analysis_id, 'total_revenue' AS metric_type, CAST(total AS DOUBLE) AS metric_value, 'revenue' AS category, NULL AS category_name, CAST(NULL AS DATE) AS metric_date FROM good
UNION ALL SELECT analysis_id, 'total_transactions', n, 'count', NULL, NULL FROM good
UNION ALL SELECT analysis_id, 'revenue', CAST(r AS DOUBLE), 'product', brand, NULL FROM cell WHERE analysis_id IN (SELECT analysis_id FROM good)
UNION ALL SELECT analysis_id, 'monthly_revenue', 5, 'time_series', 'monthly', DATE '2024-01-01' FROM good
UNION ALL SELECT analysis_id, 'monthly_revenue', n, 'time_series', 'monthly', DATE '2024-02-01' FROM good)
"""


def _extracted(spark, sf_dir):
    return extraction.extract_metrics(stored_results(spark, sf_dir))


def _plain(rows):
    return rows.withColumn("metric_value", F.col("metric_value").cast("double"))


_add("extracted_metrics", lambda s, d: _plain(_extracted(s, d)), over_sales(_EXTRACTED_SQL + "SELECT * FROM extracted"))
_add(
    "extracted_insights",
    lambda s, d: extraction.extract_insights(stored_results(s, d)),
    over_sales(STORED_SQL + """
SELECT analysis_id, 'Spent ' || CAST(total AS VARCHAR) AS insight_text, 'answer' AS insight_type, CAST(0.6 AS DOUBLE) AS confidence_score FROM docs
UNION ALL SELECT analysis_id, 'S', 'summary', 0.6 FROM docs
UNION ALL SELECT analysis_id, unnest(['Overall in May: high', 'Note: odd', 'More: a', 'More: b']), 'anomaly', 0.7 FROM docs
UNION ALL SELECT analysis_id, unnest(['Next Step: call', 'x', 'y']), 'recommendation', 0.75 FROM docs"""),
)


def _backfilled(spark, sf_dir):
    """Metrics after a backfill ran twice over part-filled tables."""
    docs = stored_results(spark, sf_dir)
    fresh = _plain(_extracted(spark, sf_dir))
    old = _plain(metrics(spark, sf_dir).drop("metric_id"))
    once = extraction.backfill(old, fresh, docs)
    return extraction.backfill(once, fresh, docs)


_add(
    "backfilled_metrics",
    _backfilled,
    over_sales(
        _EXTRACTED_SQL
        + """, old AS (SELECT l_orderkey AS analysis_id, CASE l_linenumber WHEN 1 THEN 'total_revenue' WHEN 2 THEN 'profit_margin' WHEN 3 THEN 'revenue' ELSE 'monthly_revenue' END AS metric_type,
    CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) AS metric_value, CASE l_linenumber WHEN 3 THEN 'product' WHEN 4 THEN 'time_series' END AS category,
    CASE l_linenumber WHEN 3 THEN l_returnflag WHEN 4 THEN 'monthly' END AS category_name, CASE WHEN l_linenumber = 4 THEN l_shipdate::DATE END AS metric_date
    FROM lineitem WHERE l_linenumber <= 4)
SELECT * FROM old WHERE analysis_id NOT IN (SELECT analysis_id FROM docs) UNION ALL SELECT * FROM extracted"""
    ),
)
