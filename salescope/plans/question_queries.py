"""Question-log labels over conversation turns and questions derived from orders."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from salescope.functions import fixed_values as fixed
from salescope.operators import questions as q
from salescope.plans.tables import table

QUERIES = {}
ORACLES = {}
DATA_COLUMNS = ["date", "customer", "unit_cost", "regions"]


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# Templates by customer key; Y, Z, N stand for year, next year, quarter.
TEMPLATES = [
    "Forecast revenue for QN Y, please",
    "What are the risks in Y?",
    "Hello, how are you",
    "Which clients bought most in the first half of Y?",
    "Compare sales Y-Z by region",
    "see https://docs.example.com/Y",
    "asdfghjklqwertyu",
    "Show product trend over the next 3 months",
    "Is growth likely next quarter?",
    "  ",
    "detect unusual spikes and anomaly last month",
    "second quarter of Y inventory and stock by product line",
    "The weather was nice yesterday",
    "Why did buyers leave in Y to Z, and how does that relate to the previous quarter and to the share of accounts that were closed?",
    "Is the UNIT size wrong?",
]


def question_log(spark, sf_dir):
    asked = F.get(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("o_custkey") % len(TEMPLATES)).cast("int"))
    year = F.year("o_orderdate")
    filled = F.replace(asked, F.lit("Y"), year.cast("string"))
    filled = F.replace(filled, F.lit("Z"), (year + 1).cast("string"))
    filled = F.replace(filled, F.lit("QN"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    derived = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("question_id"), filled.alias("text"))
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    said = turns.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"), "text"
    )
    return derived.unionByName(said)


def _labelled(spark, sf_dir, *labels):
    return q.label_questions(question_log(spark, sf_dir), labels, DATA_COLUMNS, months=12).select("question_id", *labels)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LISTED = ", ".join(_literal(t) for t in TEMPLATES)
LOG_SQL = f"""
WITH log AS (SELECT 'o' || o_orderkey AS question_id,
    replace(replace(replace(([{_LISTED}])[o_custkey % {len(TEMPLATES)} + 1], 'Y', CAST(year(o_orderdate) AS VARCHAR)), 'Z', CAST(year(o_orderdate) + 1 AS VARCHAR)),
            'QN', 'Q' || quarter(o_orderdate)) AS text FROM orders
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')
, l AS (SELECT question_id, text, lower(text) AS low, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS clean FROM log)
"""


def _any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_literal(w)})" for w in words) + ")"


def _score_sql(words) -> str:
    return "(" + " + ".join(f"CAST(contains(clean, {_literal(w)}) AS INTEGER)" for w in words) + ")"


_KINDS = list(fixed.QUESTION_WORDS)
SCORES_SQL = LOG_SQL + ", sc AS (SELECT *, " + ", ".join(f"{_score_sql(w)} AS {k}" for k, w in fixed.QUESTION_WORDS.items()) + " FROM l)"
SCORES_SQL += ", best AS (SELECT *, greatest(" + ", ".join(_KINDS) + ") AS top, " + " + ".join(_KINDS) + " AS hits FROM sc)"
_NAMES = ["date", "dates", "customer", "customers", "unit_cost", "unit_costs", "regions", "region"]
SCORES_SQL += (
    ", typed AS (SELECT *, CASE WHEN text IS NULL OR length(clean) < 3 THEN 'irrelevant' WHEN top = 0 THEN CASE WHEN "
    + _any_sql("clean", fixed.CONTEXT_WORDS + _NAMES)
    + " THEN 'revenue_analysis' ELSE 'irrelevant' END "
    + " ".join(f"WHEN {k} = top THEN '{k}'" for k in _KINDS)
    + " END AS question_type FROM best)"
)
_add(
    "question_types",
    lambda s, d: _labelled(s, d, "question_type"),
    SCORES_SQL + "SELECT question_id, question_type FROM typed",
)
_add(
    "question_confidence",
    lambda s, d: _labelled(s, d, "confidence", "forecast_intent", "risk_intent"),
    SCORES_SQL + f"""
SELECT question_id, CASE WHEN hits > 0 THEN round(top / hits, 4) ELSE 0 END AS confidence,
       {_any_sql('low', fixed.FORECAST_INTENT)} AS forecast_intent, {_any_sql('low', fixed.RISK_INTENT)} AS risk_intent FROM typed""",
)


def _label_sql(column: str, pattern: str, template: str) -> str:
    regex = _literal("(?i)" + pattern)
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece == "{quarter}":
            cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.QUARTER_NUMBERS.items())
            parts.append(f"CASE lower(regexp_extract({column}, {regex}, 1)) {cases} END")
        elif piece.startswith("{"):
            parts.append(f"regexp_extract({column}, {regex}, {piece[1:-1]})")
        elif piece:
            parts.append(_literal(piece))
    return " || ".join(parts)


_PERIOD_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {_literal('(?i)' + p)}) THEN {_label_sql('text', p, t)}" for p, t in fixed.PERIODS
) + " END"
_add(
    "question_periods",
    lambda s, d: _labelled(s, d, "period"),
    LOG_SQL + f"SELECT question_id, {_PERIOD_SQL} AS period FROM l",
)
_ALL_SQL = " || ".join(
    f"list_transform(regexp_extract_all(text, {_literal('(?i)' + p)}), lambda m: {_label_sql('m', p, t)})" for p, t in fixed.PERIODS
)
_add(
    "question_all_periods",
    lambda s, d: _labelled(s, d, "periods").withColumn("periods", F.array_join("periods", "; ")),
    LOG_SQL + f"""
, listed AS (SELECT question_id, {_ALL_SQL} AS p FROM l)
SELECT question_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '; ') AS periods FROM listed""",
)


def _regex_any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {_literal('(?i)' + p)})" for p in patterns) + ")"


_WORDS = ["date", "customer", "unit_cost", "unit", "cost", "regions"]
_add(
    "question_relevance",
    lambda s, d: _labelled(s, d, "relevance").select("question_id", "relevance.relevant", "relevance.reason"),
    LOG_SQL + f"""
, why AS (SELECT question_id, CASE WHEN text IS NULL OR clean = '' THEN 'no_question' WHEN {_regex_any('clean', fixed.LINK_PATTERNS)} THEN 'url'
   WHEN (length(clean) > 15 AND NOT contains(clean, ' ')) OR {_regex_any('clean', fixed.NOISE_PATTERNS)} THEN 'gibberish'
   WHEN length(clean) < 3 THEN 'too_short' WHEN {_any_sql('clean', fixed.SMALL_TALK)} THEN 'small_talk' WHEN {_any_sql('clean', _WORDS)} THEN 'column'
   WHEN {_any_sql('clean', fixed.BUSINESS_WORDS)} THEN 'business_word' WHEN {_regex_any('clean', fixed.BUSINESS_PHRASES)} THEN 'business_phrase'
   ELSE 'not_business' END AS reason FROM l)
SELECT question_id, reason IN ('no_question', 'column', 'business_word', 'business_phrase') AS relevant, reason FROM why""",
)
_ROUTES_SQL = "CASE " + " ".join(
    f"WHEN {_any_sql('low', w)}{' AND length(text) > 100' if k == 'complex' else ''} THEN '{k}'" for k, w in fixed.ROUTING_WORDS.items()
) + " ELSE 'simple' END"
_add(
    "question_routing",
    lambda s, d: _labelled(s, d, "routing_type"),
    LOG_SQL + f"SELECT question_id, {_ROUTES_SQL} AS routing_type FROM l",
)
_ELIGIBLE_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {_any_sql('low', w)} THEN '{name}' END" for name, (months, w) in fixed.TOOLS.items() if months <= 12
) + ")"
_add(
    "question_tools",
    lambda s, d: _labelled(s, d, "tools").withColumn("tools", F.array_join("tools", ",")),
    LOG_SQL + f"SELECT question_id, {_ELIGIBLE_SQL} AS tools FROM l",
)
_RECOMMENDED_SQL = "CASE question_type " + " ".join(
    f"WHEN '{k}' THEN '{','.join([*fixed.BASE_TOOLS, *t])}'" for k, t in fixed.TOOLS_BY_TYPE.items()
) + f" ELSE '{','.join([*fixed.BASE_TOOLS, *fixed.TOOLS_BY_TYPE['revenue_analysis']])}' END"
_add(
    "question_recommended_tools",
    lambda s, d: _labelled(s, d, "question_type").select(
        "question_id", F.array_join(q.recommended_tools(F.col("question_type")), ",").alias("tools")
    ),
    SCORES_SQL + f"SELECT question_id, {_RECOMMENDED_SQL} AS tools FROM typed",
)
_PLAN_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {_any_sql('low', w)} THEN '{t}' END" for w, t in fixed.PLAN_WORDS) + ")"
_add(
    "question_keyword_plan",
    lambda s, d: _labelled(s, d, "plan").withColumn("plan", F.array_join("plan", ",")),
    LOG_SQL + f"""
, p AS (SELECT question_id, {_PLAN_SQL} AS added FROM l)
SELECT question_id, CASE added WHEN '' THEN 'compute_kpis' ELSE 'compute_kpis,' || added || ',visualization' END AS plan FROM p""",
)
