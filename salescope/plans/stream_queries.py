"""Streaming jobs run to completion over ``events``; SQL sees the windows that have closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from salescope.plans import log_queries as logs
from salescope.plans.tables import table
from salescope.streaming import jobs

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _stream(spark, sf_dir):
    """The events table as a stream with its JSON number at hand."""
    schema = table(spark, sf_dir, "events").schema
    stream = jobs.read_stream(spark, f"{sf_dir}/event[s].parquet", schema)
    return stream.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _daily_costs(spark, sf_dir):
    usage = logs.token_usage(_stream(spark, sf_dir))
    closed = jobs.run_available(jobs.daily_costs(usage), "daily-costs")
    return closed.withColumn("cost", F.col("cost").cast("double"))


_add(
    "stream_daily_costs",
    _daily_costs,
    logs.COSTS_SQL + """
SELECT ts::DATE AS day, agent, "user", model, count(*) AS calls, CAST(SUM(total_cost) AS DOUBLE) AS cost FROM costs
GROUP BY ts::DATE, agent, "user", model HAVING ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
_add(
    "stream_operation_windows",
    lambda s, d: jobs.run_available(jobs.operation_windows(logs.operation_rows(_stream(s, d))), "operation-windows").drop("p95"),
    logs.OPERATIONS_SQL + """
SELECT date_trunc('hour', ts) AS start, operation, count(*) FILTER (NOT is_error) AS "count", round(avg(duration) FILTER (NOT is_error), 6) AS avg,
       max(duration) FILTER (NOT is_error) AS max, round(count(*) FILTER (is_error) / count(*), 4) AS error_rate,
       count(*) FILTER (NOT is_error AND duration > 5) AS slow_calls
FROM ops GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
_add(
    "stream_repeated_failures",
    lambda s, d: jobs.run_available(jobs.repeated_failures(logs.failure_rows(_stream(s, d))), "repeated-failures"),
    logs.FAILURES_SQL + """
, slid AS (SELECT error_type, tool, left(message, 100) AS message, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS start
           FROM failures)
SELECT start, error_type, tool, message, count(*) AS failures FROM slid
WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 1 HOUR
GROUP BY ALL HAVING count(*) >= 3""",
)


# The same with open windows: all rows count, and the flag tells which windows may still change.
_add(
    "stream_daily_costs_running",
    lambda s, d: jobs.run_windows(
        jobs.daily_costs(logs.token_usage(_stream(s, d)), running=True), ["day", "agent", "user", "model"], "daily-costs-running"
    ).withColumn("cost", F.col("cost").cast("double")),
    logs.COSTS_SQL + """
SELECT ts::DATE AS day, agent, "user", model, count(*) AS calls, CAST(SUM(total_cost) AS DOUBLE) AS cost,
       ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM costs) - INTERVAL 1 HOUR AS closed
FROM costs GROUP BY ts::DATE, agent, "user", model""",
)
_add(
    "stream_operation_windows_running",
    lambda s, d: jobs.run_windows(
        jobs.operation_windows(logs.operation_rows(_stream(s, d)), running=True), ["start", "operation"], "operation-windows-running"
    ),
    logs.OPERATIONS_SQL + """
SELECT date_trunc('hour', ts) AS start, operation, count(*) FILTER (NOT is_error) AS "count", round(avg(duration) FILTER (NOT is_error), 6) AS avg,
       max(duration) FILTER (NOT is_error) AS max, quantile_disc(duration, 0.95) FILTER (NOT is_error) AS p95,
       round(count(*) FILTER (is_error) / count(*), 4) AS error_rate, count(*) FILTER (NOT is_error AND duration > 5) AS slow_calls,
       date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ops) - INTERVAL 1 HOUR AS closed
FROM ops GROUP BY 1, 2""",
)
_add(
    "stream_repeated_failures_running",
    lambda s, d: jobs.run_windows(
        jobs.repeated_failures(logs.failure_rows(_stream(s, d)), running=True), ["start", "error_type", "tool", "message"], "repeated-failures-running"
    ),
    logs.FAILURES_SQL + """
, slid AS (SELECT error_type, tool, left(message, 100) AS message, ts, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS start
           FROM failures)
, counted AS (SELECT start, error_type, tool, message, count(*) AS failures, max(ts) AS latest FROM slid GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)
SELECT start, error_type, tool, message, failures, start + INTERVAL 24 HOUR <= (SELECT max(latest) FROM counted) - INTERVAL 1 HOUR AS closed FROM counted""",
)


def _ab(spark, sf_dir):
    rolled = jobs.run_updates(jobs.ab_rollup(logs.ab_rows(_stream(spark, sf_dir))), ["test_name", "metric_name", "version"], "ab-rollup")
    return rolled.withColumn("total", F.col("total").cast("double"))


_add(
    "stream_ab_rollup",
    _ab,
    logs.AB_SQL + """
SELECT test_name, metric_name, version, count(*) AS "count", CAST(SUM(CAST(metric_value AS DECIMAL(18,6))) AS DOUBLE) AS total,
       min(metric_value) AS min, max(metric_value) AS max FROM ab GROUP BY 1, 2, 3""",
)


def _ingested(spark, sf_dir):
    """The audit log streamed in as JSON lines by day, read back."""
    written = jobs.run_available(jobs.redacted_log(logs.audit_rows(_stream(spark, sf_dir))), "audit-ingest", "json", ["log_date"])
    return written.select(
        "entry_id", "log_date", F.get_json_object("details", "$.Auth_Token").alias("token"),
        F.get_json_object("details", "$.nested.password").alias("password"), F.get_json_object("details", "$.rows").cast("int").alias("rows"),
    )


_add(
    "stream_audit_ingest",
    _ingested,
    logs.AUDIT_SQL + "SELECT entry_id, log_date, '[REDACTED]' AS token, '[REDACTED]' AS password, k AS rows FROM log",
)
