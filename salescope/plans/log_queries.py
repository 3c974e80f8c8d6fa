"""Operation, cost, audit, failure, model-call and A/B logs derived from ``events``."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.functions.fixed_values import FIX_TEXTS, FLAT_TOKEN_PRICES, TOKEN_PRICES
from salescope.operators import audit, audit_tree, calls, costs, experiments, failures, performance
from salescope.plans.tables import table
from salescope.session import materialise, spread

QUERIES = {}
ORACLES = {}
AS_OF = "2024-01-30"
SECRET = "registered-query-secret"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _pick(number, names):
    """The name at position ``number`` modulo the list length."""
    return F.get(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int"))


def _pick_sql(number: str, names) -> str:
    listed = ", ".join("NULL" if n is None else "'" + n.replace("'", "''") + "'" for n in names)
    return f"([{listed}])[CAST({number} AS BIGINT) % {len(names)} + 1]"


EVENTS_SQL = "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"

# --- operation log ----------------------------------------------------------------
OPERATIONS = ["load", "map", "compute", "report"]


def operations(spark, sf_dir):
    return operation_rows(_events(spark, sf_dir))


def operation_rows(events):
    return events.select(
        "event_id",
        "ts",
        _pick(F.col("k"), OPERATIONS).alias("operation"),
        F.col("value").alias("duration"),
        (F.col("event_type") == "error").alias("is_error"),
    )


OPERATIONS_SQL = EVENTS_SQL + f"""
, ops AS (SELECT event_id, ts, {_pick_sql('k', OPERATIONS)} AS operation, value AS duration, event_type = 'error' AS is_error FROM e)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY duration) - 1 AS i, count(*) OVER (PARTITION BY operation) AS n
             FROM ops WHERE NOT is_error)
, pct AS (SELECT operation, max(duration) FILTER (i = least(CAST(floor(n * 0.50) AS BIGINT), n - 1)) AS p50,
                 max(duration) FILTER (i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS p95,
                 max(duration) FILTER (i = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)) AS p99 FROM ranked GROUP BY 1)
, base AS (SELECT operation, count(*) FILTER (NOT is_error) AS "count", avg(duration) FILTER (NOT is_error) AS a,
                  min(duration) FILTER (NOT is_error) AS lo, max(duration) FILTER (NOT is_error) AS hi,
                  stddev_pop(duration) FILTER (NOT is_error) AS sd, count(*) FILTER (is_error) AS errors, count(*) AS n FROM ops GROUP BY 1)
, stats AS (SELECT operation, "count", coalesce(round_even(a, 4), 0) AS avg, coalesce(round_even(lo, 4), 0) AS min, coalesce(round_even(hi, 4), 0) AS max,
                   coalesce(round_even(p50, 4), 0) AS p50, coalesce(round_even(p95, 4), 0) AS p95, coalesce(round_even(p99, 4), 0) AS p99,
                   coalesce(round_even(sd, 4), 0) AS std_dev, round_even(errors / n, 4) AS error_rate, errors
            FROM base LEFT JOIN pct USING (operation))
"""


def _stats(spark, sf_dir):
    return performance.operation_stats(operations(spark, sf_dir))


_add("operation_stats", _stats, OPERATIONS_SQL + "SELECT * FROM stats")
_add("operation_stats_approximate", lambda s, d: performance.operation_stats(operations(s, d), exact=False))
_add(
    "operation_summary",
    lambda s, d: performance.operation_summary(_stats(s, d)),
    OPERATIONS_SQL + """
SELECT CAST(SUM("count") AS BIGINT) AS total_operations, CAST(SUM(errors) AS BIGINT) AS total_errors,
       round_even(SUM(errors) / SUM("count" + errors), 4) AS overall_error_rate, count(*) AS active_operations,
       (SELECT operation FROM stats ORDER BY avg DESC, operation LIMIT 1) AS slowest_operation, max(avg) AS slowest_avg,
       (SELECT operation FROM stats ORDER BY error_rate DESC, operation LIMIT 1) AS most_error_prone, max(error_rate) AS highest_error_rate
FROM stats""",
)
_add(
    "operation_ranking",
    lambda s, d: performance.operation_ranking(_stats(s, d), "p95", 3),
    OPERATIONS_SQL + "SELECT * FROM stats ORDER BY p95 DESC, operation LIMIT 3",
)
_add(
    "slow_operations",
    lambda s, d: performance.slow_operations(_stats(s, d)),
    OPERATIONS_SQL + 'SELECT operation, avg FROM stats WHERE avg > 5 AND "count" > 0',
)
_add(
    "high_error_operations",
    lambda s, d: performance.high_error_operations(_stats(s, d)),
    OPERATIONS_SQL + 'SELECT operation, error_rate FROM stats WHERE error_rate > 0.1 AND "count" > 0',
)
_add(
    "duration_series",
    lambda s, d: performance.duration_series(operations(s, d)),
    OPERATIONS_SQL + """
SELECT operation, row_number() OVER (PARTITION BY operation ORDER BY ts, event_id) - 1 AS "index", duration FROM ops WHERE NOT is_error""",
)

# --- cost log ----------------------------------------------------------------------
MODELS = ["gpt-4o-mini", "gpt-4o", "claude-3-haiku", "o1-mini", "unlisted"]


def priced_calls(spark, sf_dir):
    return costs.call_costs(token_usage(_events(spark, sf_dir)))


def token_usage(events):
    return events.select(
        "event_id",
        "ts",
        _pick(F.col("k"), MODELS).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"),
        (F.col("k") * 3).cast("long").alias("output_tokens"),
        F.col("event_type").alias("agent"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
    )


def _price_sql(side: int) -> str:
    cases = " ".join(f"WHEN '{m}' THEN CAST('{Decimal(str(p[side])) / 1000:f}' AS DECIMAL(14,12))" for m, p in TOKEN_PRICES.items())
    return f"CASE model {cases} ELSE CAST('{Decimal(str(TOKEN_PRICES['gpt-4o-mini'][side])) / 1000:f}' AS DECIMAL(14,12)) END"


COSTS_SQL = EVENTS_SQL + f"""
, used AS (SELECT event_id, ts, {_pick_sql('k', MODELS)} AS model, CAST(floor(value * 10) AS BIGINT) AS input_tokens,
                  CAST(k * 3 AS BIGINT) AS output_tokens, event_type AS agent, 'user_' || user_id AS "user",
                  's' || user_id || '_' || strftime(ts, '%Y%m%d') AS session_id FROM e)
, parts AS (SELECT *, CAST(input_tokens AS DECIMAL(19,0)) * {_price_sql(0)} AS ic, CAST(output_tokens AS DECIMAL(19,0)) * {_price_sql(1)} AS oc FROM used)
, costs AS (SELECT *, CAST(round(ic, 6) AS DECIMAL(18,6)) AS input_cost, CAST(round(oc, 6) AS DECIMAL(18,6)) AS output_cost,
                   CAST(round(ic + oc, 6) AS DECIMAL(18,6)) AS total_cost FROM parts)
"""
_add(
    "call_costs",
    lambda s, d: priced_calls(s, d).select(
        "event_id", "model", *[F.col(c).cast("double").alias(c) for c in ("input_cost", "output_cost", "total_cost")]
    ),
    COSTS_SQL + """
SELECT event_id, model, CAST(input_cost AS DOUBLE) AS input_cost, CAST(output_cost AS DOUBLE) AS output_cost,
       CAST(total_cost AS DOUBLE) AS total_cost FROM costs""",
)
_add(
    "estimated_tokens",
    lambda s, d: costs.with_estimated_tokens(table(s, d, "conversations"), "text", "role").select(
        "conv_id", "turn", "input_tokens", "output_tokens"
    ),
    "SELECT conv_id, turn, length(text) // 4 AS input_tokens, length(role) // 4 AS output_tokens FROM conversations",
)
_add(
    "cost_totals",
    lambda s, d: costs.cost_totals(priced_calls(s, d)),
    COSTS_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS level, "{c}" AS name, count(*) AS calls, CAST(SUM(input_tokens + output_tokens) AS BIGINT) AS tokens,
            CAST(round(SUM(total_cost), 4) AS DOUBLE) AS cost FROM costs GROUP BY "{c}" """
        for c in ("session_id", "agent", "user", "model")
    ),
)
_add(
    "daily_costs",
    lambda s, d: costs.daily_costs(priced_calls(s, d)),
    COSTS_SQL + "SELECT ts::DATE AS day, CAST(round(SUM(total_cost), 4) AS DOUBLE) AS cost, count(*) AS calls FROM costs GROUP BY 1",
)
_SPINE_SQL = "SELECT unnest(generate_series(DATE '{0}' - INTERVAL {1} DAY, DATE '{0}'::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day"
_add(
    "daily_cost_report",
    # Reaches past the last event, so the newest days are empty.
    lambda s, d: costs.daily_cost_report(priced_calls(s, d), "2024-02-04", 10),
    COSTS_SQL + f"""
, spine AS ({_SPINE_SQL.format('2024-02-04', 9)})
SELECT day, coalesce(CAST(round(SUM(total_cost), 4) AS DOUBLE), 0) AS cost, count(event_id) AS calls
FROM spine LEFT JOIN costs ON ts::DATE = day GROUP BY 1""",
)
_add(
    "cost_report",
    lambda s, d: costs.cost_report(priced_calls(s, d), AS_OF, 7),
    COSTS_SQL + ", recent AS (SELECT * FROM costs WHERE ts >= DATE '2024-01-24' AND ts < DATE '2024-01-31') "
    + "SELECT 'total' AS section, 'total' AS name, count(*) AS calls, CAST(round(SUM(total_cost), 4) AS DOUBLE) AS cost FROM recent UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT '{c}', "{c}", count(*), CAST(round(SUM(total_cost), 4) AS DOUBLE) FROM recent GROUP BY "{c}" """
        for c in ("agent", "user", "model")
    ),
)
for _who in ("agent", "user"):
    _add(
        f"top_{_who}s_by_cost",
        lambda s, d, _who=_who: costs.top_by_cost(priced_calls(s, d), _who),
        COSTS_SQL + f"""
SELECT "{_who}", CAST(round(SUM(total_cost), 4) AS DOUBLE) AS cost FROM costs GROUP BY 1 ORDER BY SUM(total_cost) DESC, 1 LIMIT 5""",
    )

# --- failure log ---------------------------------------------------------------------
ERROR_TYPES = ["KeyError", "ValueError", "TypeError", "ImportError", "ZeroDivisionError", "AttributeError", "CustomError"]
TOOLS = [None, "kpis", "forecast"]
MESSAGES = ["'revenue'", "invalid date given", "'NoneType' object is not iterable", "could not convert to float", "No module named 'lib'"]
COLUMNS = ["date", "customer", "product", "region", "cost", "currency", "quantity", "status", "notes", "profit", "tax", "bin"]


def failure_log(spark, sf_dir):
    return failure_rows(_events(spark, sf_dir))


def failure_rows(events):
    errors = events.where(F.col("event_type") == "error")
    listed = F.array(*[F.lit(c) for c in COLUMNS])
    return errors.select(
        F.col("event_id").alias("failure_id"),
        "ts",
        _pick(F.col("k"), ERROR_TYPES).alias("error_type"),
        _pick(F.col("user_id"), TOOLS).alias("tool"),
        _pick(F.col("user_id"), MESSAGES).alias("message"),
        F.when(F.col("k") % 3 == 0, listed).when(F.col("k") % 3 == 1, F.slice(listed, 1, 3)).alias("available_columns"),
        F.when(F.col("k") % 2 == 0, "DataFrame").alias("object_type"),
    )


def fix_log(spark, sf_dir):
    """Outcome of a fix for every error and signup event."""
    tried = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return tried.select(
        _pick(F.col("k"), ERROR_TYPES).alias("error_type"), (F.col("value") > 30).alias("success"),
        (F.col("k") % 5 == 0).alias("auto_apply"), (F.col("value") > 30).alias("fixed"),
    )


FAILURES_SQL = EVENTS_SQL + f"""
, failures AS (SELECT event_id AS failure_id, ts, k, {_pick_sql('k', ERROR_TYPES)} AS error_type, {_pick_sql('user_id', TOOLS)} AS tool,
                      {_pick_sql('user_id', MESSAGES)} AS message, CASE WHEN k % 2 = 0 THEN 'DataFrame' END AS object_type FROM e WHERE event_type = 'error')
, fixes AS (SELECT {_pick_sql('k', ERROR_TYPES)} AS error_type, value > 30 AS success, k % 5 = 0 AS auto_apply FROM e WHERE event_type IN ('error', 'signup'))
, alike AS (SELECT *, count(*) OVER (PARTITION BY error_type, coalesce(tool, ''), left(message, 100) ORDER BY ts
                                     RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS similar_count FROM failures)
, rates AS (SELECT error_type, count(*) AS fixes, avg(CAST(success AS INTEGER)) AS success_rate FROM fixes GROUP BY 1)
"""


def _text_sql(key: str, *parts: str) -> str:
    pieces = FIX_TEXTS[key].split("%s")
    joined = "'" + pieces[0].replace("'", "''") + "'"
    for part, piece in zip(parts, pieces[1:]):
        joined += f" || {part} || '" + piece.replace("'", "''") + "'"
    return joined


_NAMED = "CASE WHEN contains(message, '''') THEN split_part(message, '''', 2) ELSE 'unknown' END"
_SUGGESTION_SQL = f"""CASE error_type
  WHEN 'KeyError' THEN CASE k % 3 WHEN 0 THEN {_text_sql('KeyError, more columns', _NAMED, "'" + ', '.join(COLUMNS[:10]) + "'")}
       WHEN 1 THEN {_text_sql('KeyError, up to 10 columns', _NAMED, "'" + ', '.join(COLUMNS[:3]) + "'")} ELSE {_text_sql('KeyError', _NAMED)} END
  WHEN 'ValueError' THEN CASE WHEN contains(lower(message), 'date') THEN {_text_sql('ValueError, date')}
       WHEN contains(lower(message), 'numeric') OR contains(lower(message), 'float') OR contains(lower(message), 'int') THEN {_text_sql('ValueError, number')}
       ELSE {_text_sql('ValueError')} END
  WHEN 'TypeError' THEN CASE WHEN contains(lower(message), 'nonetype') THEN {_text_sql('TypeError, none')} ELSE {_text_sql('TypeError')} END
  WHEN 'ImportError' THEN {_text_sql('ImportError', _NAMED, _NAMED)}
  WHEN 'ZeroDivisionError' THEN {_text_sql('ZeroDivisionError')}
  WHEN 'AttributeError' THEN CASE WHEN object_type IS NOT NULL THEN {_text_sql('AttributeError, known type', _NAMED, 'object_type')}
       ELSE {_text_sql('AttributeError', _NAMED)} END END"""

_add(
    "similar_failures",
    lambda s, d: failures.similar_failures(failure_log(s, d)).select("failure_id", "error_type", "tool", "similar_count"),
    FAILURES_SQL + "SELECT failure_id, error_type, tool, similar_count FROM alike",
)
_add(
    "fix_success_rates",
    lambda s, d: failures.fix_success_rates(fix_log(s, d)),
    FAILURES_SQL + "SELECT * FROM rates",
)
_add(
    "failure_suggestions",
    lambda s, d: failures.with_suggestions(failure_log(s, d)).select("failure_id", "suggestion"),
    FAILURES_SQL + f"SELECT failure_id, {_SUGGESTION_SQL} AS suggestion FROM failures",
)
_add(
    "fix_actions",
    lambda s, d: failures.fix_actions(failure_log(s, d), fix_log(s, d)),
    FAILURES_SQL + f"""
, rated AS (SELECT failure_id, error_type, tool, similar_count, {_SUGGESTION_SQL} AS suggestion,
   round_even(least(least(0.3::DOUBLE + (similar_count - 3) * 0.1::DOUBLE, 0.9::DOUBLE) + coalesce(success_rate, 0) * 0.15::DOUBLE, 0.95::DOUBLE), 2) AS confidence
   FROM alike LEFT JOIN rates USING (error_type) WHERE similar_count >= 3 AND error_type <> 'CustomError')
SELECT *, confidence >= 0.85 AND similar_count > 5 AS auto_apply FROM rated""",
)
_add(
    "action_report",
    lambda s, d: failures.action_report(fix_log(s, d)),
    FAILURES_SQL + """
SELECT count(*) AS total_actions, count(*) FILTER (auto_apply) AS auto_applied, count(*) FILTER (NOT auto_apply) AS manual_applied,
       count(*) FILTER (success) AS resolved, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS success_rate FROM fixes""",
)
_add(
    "recent_failures",
    lambda s, d: failures.recent_failures(failure_log(s, d)).select("failure_id", "error_type", "message"),
    FAILURES_SQL + "SELECT failure_id, error_type, message FROM failures ORDER BY ts DESC, failure_id DESC LIMIT 10",
)
_add(
    "common_errors",
    lambda s, d: failures.common_errors(failure_log(s, d)),
    FAILURES_SQL + "SELECT error_type, count(*) AS failures FROM failures GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
_add(
    "failure_retention",
    lambda s, d: failures.retention_counts(failure_log(s, d), AS_OF, 10),
    FAILURES_SQL + """
SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS removed, count(*) FILTER (ts IS NULL OR ts >= TIMESTAMP '2024-01-20') AS kept,
       count(*) FILTER (ts IS NULL) AS undated FROM failures""",
)
_add(
    "failures_kept",
    lambda s, d: failures.keep_recent(failure_log(s, d), AS_OF, 10).select("failure_id", "error_type"),
    FAILURES_SQL + "SELECT failure_id, error_type FROM failures WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-20'",
)

# --- model calls -------------------------------------------------------------------------


def model_calls(spark, sf_dir):
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("call_id"),
        "ts",
        _pick(F.col("k"), MODELS).alias("model"),
        F.col("value").alias("latency_ms"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"),
        (F.col("k") * 3).cast("long").alias("output_tokens"),
        (F.col("event_type") != "error").alias("success"),
    )


_FLAT_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {p!r}::DOUBLE" for m, p in FLAT_TOKEN_PRICES.items()) + " ELSE 0.00015::DOUBLE END"
CALLS_SQL = EVENTS_SQL + f"""
, calls AS (SELECT event_id AS call_id, ts, {_pick_sql('k', MODELS)} AS model, value AS latency_ms, CAST(floor(value * 10) AS BIGINT) AS input_tokens,
                   CAST(k * 3 AS BIGINT) AS output_tokens, event_type <> 'error' AS success FROM e)
"""
_add(
    "model_call_stats",
    lambda s, d: calls.call_stats(model_calls(s, d)),
    CALLS_SQL + f"""
SELECT model, count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, count(*) FILTER (NOT success) AS failed_calls,
       round(avg(latency_ms) FILTER (success), 6) AS avg_latency_ms, min(latency_ms) FILTER (success) AS min_latency_ms,
       max(latency_ms) FILTER (success) AS max_latency_ms, CAST(SUM(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(SUM(output_tokens) AS BIGINT) AS total_output_tokens, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
       round(SUM(input_tokens + output_tokens) / 1000 * {_FLAT_SQL}, 4) AS estimated_cost
FROM calls GROUP BY model""",
)
_add(
    "latest_calls_per_model",
    lambda s, d: calls.keep_latest_per_model(model_calls(s, d), 100).select("model", "call_id"),
    CALLS_SQL + "SELECT model, call_id FROM calls QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC, call_id DESC) <= 100",
)
_add(
    "latest_calls",
    lambda s, d: calls.keep_latest(model_calls(s, d), 500).select("model", "call_id"),
    CALLS_SQL + "SELECT model, call_id FROM calls ORDER BY ts DESC, call_id DESC LIMIT 500",
)

# --- A/B tests -------------------------------------------------------------------------------
TESTS = ["prompt_style", "ranking"]
METRICS = ["latency", "answer_length", "score"]


def ab_metrics(spark, sf_dir):
    return ab_rows(_events(spark, sf_dir))


def ab_rows(events):
    rows = events.select(
        "ts", "user_id", _pick(F.col("k"), TESTS).alias("test_name"), _pick(F.col("k"), METRICS).alias("metric_name"),
        F.col("value").alias("metric_value"),
    )
    return rows.withColumn("version", experiments.assigned_version(F.col("user_id"), F.col("test_name")))


AB_SQL = EVENTS_SQL + f"""
, named AS (SELECT ts, user_id, {_pick_sql('k', TESTS)} AS test_name, {_pick_sql('k', METRICS)} AS metric_name, value AS metric_value FROM e)
, ab AS (SELECT *, CASE WHEN CAST(('0x' || md5(user_id || ':' || test_name)[1:8]) AS BIGINT) / 4294967296 < 0.5 THEN 'v2' ELSE 'v1' END AS version FROM named)
"""
_add(
    "ab_assignment",
    lambda s, d: ab_metrics(s, d).groupBy("test_name", "user_id", "version").agg(F.count("*").alias("rows")),
    AB_SQL + "SELECT test_name, user_id, version, count(*) AS rows FROM ab GROUP BY ALL",
)
_add(
    "ab_results",
    lambda s, d: experiments.metric_results(ab_metrics(s, d)),
    AB_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY test_name, metric_name, version ORDER BY metric_value) - 1 AS i,
               count(*) OVER (PARTITION BY test_name, metric_name, version) AS n FROM ab)
SELECT test_name, metric_name, version, round(avg(metric_value), 6) AS avg, min(metric_value) AS min, max(metric_value) AS max,
       count(*) AS "count", CASE WHEN count(*) >= 20 THEN max(metric_value) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) END AS p95
FROM r GROUP BY 1, 2, 3""",
)
_add(
    "ab_winners",
    lambda s, d: experiments.metric_winners(ab_metrics(s, d)),
    AB_SQL + """
, p AS (SELECT test_name, metric_name, round(avg(metric_value) FILTER (version = 'v1'), 6) AS control_avg,
               round(avg(metric_value) FILTER (version = 'v2'), 6) AS treatment_avg FROM ab GROUP BY 1, 2)
SELECT *, CASE WHEN control_avg IS NULL OR treatment_avg IS NULL THEN NULL
   WHEN metric_name = 'latency' THEN CASE WHEN treatment_avg < control_avg THEN 'v2' ELSE 'v1' END
   ELSE CASE WHEN treatment_avg > control_avg THEN 'v2' ELSE 'v1' END END AS winner FROM p""",
)
_add(
    "version_benchmark",
    lambda s, d: experiments.version_benchmark(ab_metrics(s, d).withColumnRenamed("metric_value", "latency")),
    AB_SQL + "SELECT version, round(avg(metric_value), 6) AS avg_latency FROM ab GROUP BY 1",
)

# --- audit log ---------------------------------------------------------------------------------


def audit_log(spark, sf_dir):
    return audit_rows(_events(spark, sf_dir))


def audit_rows(events):
    user = F.col("user_id").cast("string")
    details = F.to_json(
        F.struct(
            F.col("k").alias("rows"),
            F.concat(F.lit("t"), user).alias("Auth_Token"),
            F.struct(F.lit("p").alias("password"), F.col("k").alias("size")).alias("nested"),
            F.array(F.struct(F.lit("x").alias("api_key"), user.alias("owner"))).alias("items"),
        )
    )
    return events.select(
        F.col("event_id").alias("entry_id"),
        "ts",
        F.col("ts").cast("date").alias("log_date"),
        F.col("event_type").alias("action_type"),
        _pick(F.col("k"), OPERATIONS).alias("agent"),
        F.concat(F.lit("user_"), user).alias("user"),
        (F.col("event_type") != "error").alias("success"),
        details.alias("details"),
    )


def audit_chain(spark, sf_dir):
    """The whole audit log, redacted, chained per day and stored."""
    events = _events(spark, sf_dir)
    # few files make few tasks; redaction is spread evenly
    log = audit_rows(spread(events, events.count(), "event_id")).withColumn("details", audit.redact_json(F.col("details")))
    entry = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "action_type", "agent", "user", "success", "details"
        )
    )
    return materialise(audit.build_chain(log.withColumn("entry", entry), SECRET, ["ts", "entry_id"]), "audit-chain")


AUDIT_SQL = EVENTS_SQL + f"""
, log AS (SELECT event_id AS entry_id, ts, ts::DATE AS log_date, event_type AS action_type, {_pick_sql('k', OPERATIONS)} AS agent,
                 'user_' || user_id AS "user", event_type <> 'error' AS success, k, user_id FROM e)
"""
def _redacted_forms(spark, sf_dir):
    """Six levels, a list on top, broken text and escaped quotes around a secret."""
    e = audit_log(spark, sf_dir)
    k = (F.col("entry_id") % 4).cast("int")
    number = F.col("entry_id").cast("string")
    deep = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":{"token":"t","rows":'), number, F.lit("}}}}}}}"))
    listed = F.concat(F.lit('[{"api_key":"t"},{"n":'), number, F.lit(".50}]"))
    broken = F.concat(F.lit('{"note":"a\\"b","password":"'), number, F.lit('"'))
    quoted = F.concat(F.lit('{"note":"say \\"token\\": 5","secret":"a\\"'), number, F.lit('"}'))
    text = F.when(k == 0, deep).when(k == 1, listed).when(k == 2, broken).otherwise(quoted)
    return e.select("entry_id", audit.redact_json(text).alias("details"))


_add(
    "redacted_forms",
    _redacted_forms,
    AUDIT_SQL + r"""
SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN '{"a":{"b":{"c":{"d":{"e":{"f":{"token":"[REDACTED]","rows":' || entry_id || '}}}}}}}'
    WHEN 1 THEN '[{"api_key":"[REDACTED]"},{"n":' || entry_id || '.50}]' WHEN 2 THEN '[REDACTED]'
    ELSE '{"note":"say \"token\": 5","secret":"[REDACTED]"}' END AS details FROM log""",
)
_add(
    "redacted_details",
    lambda s, d: audit_log(s, d)
    .select("entry_id", audit.redact_json(F.col("details")).alias("r"))
    .select(
        "entry_id",
        F.get_json_object("r", "$.rows").cast("int").alias("rows"),
        F.get_json_object("r", "$.Auth_Token").alias("token"),
        F.get_json_object("r", "$.nested.password").alias("nested_password"),
        F.get_json_object("r", "$.nested.size").cast("int").alias("nested_size"),
        F.get_json_object("r", "$.items[0].api_key").alias("item_key"),
        F.get_json_object("r", "$.items[0].owner").alias("item_owner"),
    ),
    AUDIT_SQL + """
SELECT entry_id, k AS rows, '[REDACTED]' AS token, '[REDACTED]' AS nested_password, k AS nested_size, '[REDACTED]' AS item_key,
       CAST(user_id AS VARCHAR) AS item_owner FROM log""",
)
_add(
    "audit_query",
    lambda s, d: audit.query_log(
        audit_log(s, d), agent="compute", action_type="purchase", success=True, start="2024-01-05", end="2024-01-20", limit=50
    ).select("entry_id", "user", "log_date"),
    AUDIT_SQL + """
SELECT entry_id, "user", log_date FROM log WHERE agent = 'compute' AND action_type = 'purchase' AND success
  AND log_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY ts, entry_id LIMIT 50""",
)
_add(
    "audit_success_rate",
    lambda s, d: audit.success_rate(audit_log(s, d)),
    AUDIT_SQL + """
SELECT count(*) AS entries, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) * 100 / count(*), 4) AS success_rate FROM log""",
)
_add(
    "audit_daily_counts",
    lambda s, d: audit.daily_counts(audit_log(s, d), "2024-02-02", 7),
    AUDIT_SQL + f"""
, spine AS ({_SPINE_SQL.format('2024-02-02', 6)})
SELECT day, count(entry_id) AS entries FROM spine LEFT JOIN log ON log_date = day GROUP BY 1""",
)
_add("audit_chain", audit_chain)
_add(
    "audit_chain_verified",
    lambda s, d: audit.verify_chains(audit_chain(s, d), SECRET),
    AUDIT_SQL + "SELECT log_date, count(*) AS entries, true AS intact, CAST(NULL AS BIGINT) AS first_broken FROM log GROUP BY 1",
)
_add(
    "audit_tampering_found",
    # On even days the sixth entry is rewritten after chaining.
    lambda s, d: audit.verify_chains(
        audit_chain(s, d).withColumn(
            "payload",
            F.when(
                (F.dayofmonth("log_date") % 2 == 0) & (F.col("seq") == 5), F.replace("payload", F.lit("user_"), F.lit("root_"))
            ).otherwise(F.col("payload")),
        ),
        SECRET,
    ),
    AUDIT_SQL + """
SELECT log_date, count(*) AS entries, day(log_date) % 2 = 1 OR count(*) <= 5 AS intact,
       CASE WHEN day(log_date) % 2 = 0 AND count(*) > 5 THEN CAST(5 AS BIGINT) END AS first_broken FROM log GROUP BY 1""",
)
_add(
    "audit_recent_days_verified",
    lambda s, d: audit.verify_recent(audit_chain(s, d), SECRET, "2024-02-02", 30),
    AUDIT_SQL + f"""
, spine AS ({_SPINE_SQL.format('2024-02-02', 29)})
SELECT day, count(entry_id) AS entries, true AS intact FROM spine LEFT JOIN log ON log_date = day GROUP BY 1""",
)


# --- audit chains by shard ----------------------------------------------------------
def audit_shards(spark, sf_dir, shards):
    """The plain fields of the audit log chained within shards by entry number, stored."""
    log = audit_log(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    entry = F.to_json(F.struct("action_type", "agent", "success", stamp, "user"))
    return materialise(audit_tree.sharded_chain(log.withColumn("entry", entry), SECRET, ["ts", "entry_id"], shards, F.col("entry_id")), "audit-shards")


def _tampered(spark, sf_dir):
    """Entries whose payload was rewritten after the tree was stored: the third of each even shard on even days."""
    chain = audit_shards(spark, sf_dir, 16)
    hit = (F.dayofmonth("log_date") % 2 == 0) & (F.col("shard") % 2 == 0) & (F.col("seq") == 2)
    changed = chain.withColumn("payload", F.when(hit, F.replace("payload", F.lit("user_"), F.lit("root_"))).otherwise(F.col("payload")))
    return audit_tree.changed_entries(audit_tree.hash_tree(chain), audit_tree.hash_tree(changed))


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in SECRET.encode().ljust(64, b"\0")).hex()


def _shards_sql(shards: int) -> str:
    text = """'{"action_type": "' || action_type || '", "agent": "' || agent || '", "prev_hash": "' || PREV || '", "success": ' || CAST(success AS VARCHAR)
              || ', "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '", "user": "' || "user" || '"}'"""
    digest = f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(PAYLOAD))))"
    genesis, previous = (text.replace("PREV", x) for x in (f"'{audit.GENESIS_HASH}'", "c.hash"))
    return AUDIT_SQL.replace("WITH e", "WITH RECURSIVE e", 1) + f"""
, dealt AS (SELECT *, CAST(entry_id % {shards} AS INTEGER) AS shard, row_number() OVER (PARTITION BY log_date, entry_id % {shards} ORDER BY ts, entry_id) - 1 AS seq FROM log)
, chain AS (
    SELECT log_date, shard, seq, {genesis} AS payload, '{audit.GENESIS_HASH}' AS prev_hash, {digest.replace("PAYLOAD", genesis)} AS hash FROM dealt WHERE seq = 0
    UNION ALL
    SELECT d.log_date, d.shard, d.seq, {previous}, c.hash, {digest.replace("PAYLOAD", previous)}
    FROM chain c JOIN dealt d ON d.log_date = c.log_date AND d.shard = c.shard AND d.seq = c.seq + 1)
"""


for _shards, _name in ((1, "audit_chain_one_shard"), (16, "audit_chain_sixteen_shards")):
    _add(_name, lambda s, d, n=_shards: audit_shards(s, d, n), _shards_sql(_shards) + "SELECT * FROM chain")
_add(
    "audit_shards_verified",
    lambda s, d: audit_tree.broken_shards(audit_shards(s, d, 16), SECRET),
    AUDIT_SQL + """
SELECT log_date, CAST(entry_id % 16 AS INTEGER) AS shard, count(*) AS entries, true AS intact, CAST(NULL AS BIGINT) AS first_broken FROM log GROUP BY 1, 2""",
)
_add(
    "audit_tampering_located",
    _tampered,
    AUDIT_SQL + """
, dealt AS (SELECT log_date, CAST(entry_id % 16 AS INTEGER) AS shard, row_number() OVER (PARTITION BY log_date, entry_id % 16 ORDER BY ts, entry_id) - 1 AS seq FROM log)
SELECT * FROM dealt WHERE day(log_date) % 2 = 0 AND shard % 2 = 0 AND seq = 2""",
)
