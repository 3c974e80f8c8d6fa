import datetime
import json
from decimal import Decimal

import pytest

from salescope.functions.fixed_values import TOOLS
from salescope.operators import extraction, history, questions

T = datetime.datetime(2024, 1, 1)


def test_trend(spark):
    days = lambda *values: spark.createDataFrame([(T.date() + datetime.timedelta(i), float(v)) for i, v in enumerate(values)], "day date, value double")
    assert tuple(history.metric_trend(days(100, 5, 150)).first()) == (3, "up", 50.0)
    assert tuple(history.metric_trend(days(100, 100)).first()) == (2, "down", 0.0)
    assert tuple(history.metric_trend(days(0, 10)).first()) == (2, None, None)
    assert tuple(history.metric_trend(days(7)).first()) == (1, None, None)


def test_user_scope_and_deletion(spark):
    h = spark.createDataFrame([(1, 7, "file", "q", T, "done", "{}"), (2, 8, "file", "q", T, "done", "{}")], "id long, user_id long, analysis_type string, question string, created_at timestamp_ntz, status string, data_source string")
    m = spark.createDataFrame(
        [(10, 1, "total_revenue", Decimal("5.00"), None, None, None), (11, 1, "total_revenue", Decimal("6.00"), None, None, None), (12, 2, "profit_margin", Decimal("0.50"), None, None, None)],
        "metric_id long, analysis_id long, metric_type string, metric_value decimal(20,2), metric_date date, category string, category_name string",
    )
    i = spark.createDataFrame([(1, "answer", "t", Decimal("0.90"))], "analysis_id long, insight_type string, insight_text string, confidence_score decimal(5,2)")
    page = history.history_page(h, m, i, user_id=7).collect()
    assert [(r.analysis_id, r.total_revenue, r.profit_margin, r.insight_count, r.total) for r in page] == [(1, 5.0, None, 1, 1)]
    assert history.owned_metrics(m, h, user_id=8).count() == 1
    left = history.without_analyses({"history": h, "metrics": m, "insights": i}, spark.createDataFrame([(1,)], "analysis_id long"))
    assert {k: v.count() for k, v in left.items()} == {"history": 1, "metrics": 1, "insights": 0}


def test_metric_extraction(spark):
    raw = {
        "compute_kpis": {"total_revenue": 10, "profit_margin": 0.25, "unknown": 1},
        "revenue_by_product": {"p": 5, "q": {"total_revenue": 7.5}, "r": "text", "s": {"x": 1}},
        "revenue_by_region": {"EU": 1},
        "top_customers": {"c": 2.0},
        "monthly_trend": {"2024-02": 3, "March 2024": 4, "never": 5},
    }
    frame = spark.createDataFrame([(1, json.dumps(raw)), (2, "not json"), (3, None), (4, "{}")], "id long, raw_results string")
    got = {(r.metric_type, r.category, r.category_name, str(r.metric_date)): float(r.metric_value) for r in extraction.extract_metrics(frame).collect()}
    assert got == {
        ("total_revenue", "revenue", None, "None"): 10.0, ("profit_margin", "margin", None, "None"): 0.25,
        ("revenue", "product", "p", "None"): 5.0, ("revenue", "product", "q", "None"): 7.5,
        ("revenue", "region", "EU", "None"): 1.0, ("revenue", "customer", "c", "None"): 2.0,
        ("monthly_revenue", "time_series", "monthly", "2024-02-01"): 3.0, ("monthly_revenue", "time_series", "monthly", "2024-03-01"): 4.0,
    }


@pytest.mark.parametrize(
    "anomalies,texts",
    [
        ({"A": {"May": "high", "June": ""}, "B": "odd", "C": ["x", ""]}, ["A in May: high", "B: odd", "C: x"]),
        (["one", "", {"D": "two"}], ["one", "D: two"]),
        ("plain", ["plain"]),
        ("", []),
        (None, []),
    ],
)
def test_anomaly_texts(spark, anomalies, texts):
    frame = spark.createDataFrame([(1, json.dumps({"anomalies": anomalies}))], "id long, insights_json string")
    assert [r.insight_text for r in extraction.extract_insights(frame).collect()] == texts


def test_insight_defaults(spark):
    frame = spark.createDataFrame([(1, '{"answer": ""}')], "id long, insights_json string")
    got = [(r.insight_type, r.insight_text, r.confidence_score) for r in extraction.extract_insights(frame, fill_defaults=True).collect()]
    assert got == [("answer", "Analysis complete.", 0.9), ("summary", "Analysis complete.", 0.85)]


def test_summary_of_the_whole_answer(spark):
    frame = spark.createDataFrame([(1, json.dumps({"answer": "x" * 300}))], "id long, insights_json string")
    lengths = lambda **chars: [len(r.insight_text) for r in extraction.extract_insights(frame, fill_defaults=True, **chars).collect()]
    assert lengths() == [300, 200] and lengths(summary_chars=None) == [300, 300]


def label(spark, text, name, **options):
    frame = spark.createDataFrame([(text,)], "text string")
    return questions.label_questions(frame, [name], **options).first()[name]


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Forecast revenue for Q1 2025", "forecast"), ("What are the risks?", "risk"), ("How is the business performance?", "performance"),
        ("Show revenue by product", "revenue_analysis"), ("hi", "irrelevant"), ("", "irrelevant"), (None, "irrelevant"),
        ("where is it", "revenue_analysis"), ("blue sky", "irrelevant"),
    ],
)
def test_types(spark, text, kind):
    assert label(spark, text, "question_type") == kind


@pytest.mark.parametrize(
    "text,period",
    [
        ("revenue in Q3 2024", "Q3 2024"), ("the first quarter of 2025", "Q1 2025"), ("in 2024", "2024"), ("second half of 2024", "H2 2024"),
        ("from 2020 to 2023", "2020-2023"), ("2020-2023", "2020-2023"), ("next 6 months", "next 6 months"), ("NEXT quarter", "next_quarter"),
        ("previous year", "last_year"), ("whenever", None), (None, None),
    ],
)
def test_periods(spark, text, period):
    assert label(spark, text, "period") == period


def test_all_periods(spark):
    assert label(spark, "Q1 2024, Q2 2024, q1 2024 and next year", "periods") == ["Q1 2024", "Q2 2024", "2024", "next_year"]
    assert label(spark, None, "periods") == []


@pytest.mark.parametrize(
    "text,reason",
    [
        (None, "no_question"), ("see https://x.y", "url"), ("asdfghjklqwe", "gibberish"), ("hello there friend", "small_talk"),
        ("what about territory_code?", "column"), ("total revenue please", "business_word"), ("tell me a joke", "not_business"),
    ],
)
def test_relevance(spark, text, reason):
    assert label(spark, text, "relevance", columns=["territory_code"]).reason == reason


def test_tools(spark):
    assert label(spark, "forecast the growth trend", "tools", months=3) == ["monthly_growth"]
    assert "forecast_revenue" in label(spark, "forecast the growth trend", "tools", months=12)
    more = questions.with_tool("weather", words=["rain"])
    assert label(spark, "will it rain", "tools", tools=more) == ["weather"] and "weather" not in TOOLS
    assert label(spark, "product growth", "plan") == ["compute_kpis", "revenue_by_product", "monthly_growth", "visualization"]
    assert label(spark, "hmm", "plan") == ["compute_kpis"]


def test_routing_needs_length(spark):
    assert label(spark, "why so low", "routing_type") == "simple"
    assert label(spark, "why so low " + "x" * 100, "routing_type") == "complex"


def test_details_of_all_analyses_sort_no_rows(spark):
    """Ids are hashed, the wide rows only stream by; null and repeated ids neither match nor multiply rows."""
    h = spark.createDataFrame([(i, 7) for i in (1, 2, 2, None)], "id long, user_id long")
    m = spark.createDataFrame([(a, "revenue", Decimal(a or 0)) for a in (1, 2, 3, None, 1)], "analysis_id long, metric_type string, metric_value decimal(20,2)").selectExpr(
        "*", "cast(null as date) AS metric_date", "cast(null as string) AS category", "cast(null as string) AS category_name"
    )
    i = spark.createDataFrame([(2, "answer", "t", Decimal("0.90"))], "analysis_id long, insight_type string, insight_text string, confidence_score decimal(5,2)")
    c = spark.createDataFrame([(3, "bar", "/a/b.png", None)], "analysis_id long, chart_type string, chart_path string, chart_data string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        details = history.analysis_detail(h, m, i, c)
        assert "Sort" not in details._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.analysis_id, r.section) for r in details.collect()) == [(1, "metrics"), (1, "metrics"), (2, "insights"), (2, "metrics")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_backfill_sorts_no_rows(spark):
    rows = "analysis_id long, metric_type string, metric_value double"
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0), (None, "c", 3.0)], rows)
    fresh, docs = spark.createDataFrame([(2, "b", 5.0)], rows), spark.createDataFrame([(2,), (2,), (3,), (None,)], "id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = extraction.backfill(old, fresh, docs)
        assert "Sort" not in filled._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, (tuple(r) for r in filled.collect()))) == ["(1, 'a', 1.0)", "(2, 'b', 5.0)", "(None, 'c', 3.0)"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_results_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    from salescope import session
    from salescope.plans import history_queries

    lines = spark.range(600).selectExpr(
        "DATE'2024-01-05' AS date", "concat('Customer#', lpad(string(id % 97), 9, '0')) AS customer", "concat('Brand#', id % 7) AS brand", "cast(id AS decimal(18,2)) AS revenue"
    )
    monkeypatch.setattr(history_queries, "sales", lambda s, d, columns: lines.select(*columns))
    monkeypatch.setattr(history_queries, "table", lambda s, d, name: lines)
    plain = sorted(history_queries.stored_results(spark, "").collect())
    monkeypatch.setattr(session, "LEFT_TO_SPARK", 100)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    dealt = history_queries.stored_results(spark, "")
    assert dealt.rdd.getNumPartitions() == 12 and sorted(dealt.collect()) == plain and len(plain) == 97
