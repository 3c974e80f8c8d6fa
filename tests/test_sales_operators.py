import datetime

import pytest
from pyspark.sql import functions as F

from salescope.operators import aggregates, anomalies, reports, timeseries
from salescope.plans.registry import Registry

ROWS = [
    ("2024-01-05", "a", "P1", "EU", 100, 50, 1.0, "paid"),
    ("2024-01-20", None, "P1", "EU", 50.5, 20, 2.0, "pending"),
    ("2024-03-02", "", "P2", "US", 200, 100, 3.0, "failed"),
    ("2024-03-03", "b", None, "US", None, 10, None, None),
    (None, "a", "P2", None, 10, 5, 1.0, "paid"),
]


def test_kpis(sales_of):
    row = aggregates.kpis(sales_of([("2024-01-01", "a", "p", "r", 100, 50, 1.0, "paid"), ("2024-01-02", "b", "p", "r", 200, 100, 1.0, "paid")])).first()
    assert tuple(row) == (300.0, 150.0, 150.0, 0.5, 150.0)


def test_kpis_on_nothing(sales_of):
    assert tuple(aggregates.kpis(sales_of([])).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)
    only_null = sales_of([("2024-01-01", "a", "p", "r", None, None, None, None)])
    assert tuple(aggregates.kpis(only_null).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert aggregates.revenue_per_unit(sales_of([])).first()[0] is None
    assert timeseries.monthly_growth(sales_of(ROWS[:1])).count() == 0


def test_missing_columns(sales_of):
    sales = sales_of(ROWS)
    assert aggregates.kpis(sales.drop("cost")).first().profit_margin == 1.0
    assert aggregates.revenue_by(sales.drop("region"), "region").count() == 0
    assert aggregates.revenue_by_payment_status(sales.drop("payment_status")) is None
    assert aggregates.total_units(sales.drop("quantity")) is None
    estimated = aggregates.kpis_from_similar_names(sales.select(F.col("revenue").alias("Net Sales"))).first()
    assert estimated.cost_estimated and estimated.profit_margin == 0.4 and estimated.total_cost == 216.0
    with pytest.raises(ValueError):
        aggregates.kpis(sales.select("date"))


def test_breakdowns(sales_of):
    sales = sales_of(ROWS)
    assert [tuple(r) for r in aggregates.revenue_by(sales, "customer").collect()] == [("Unknown", 250.0), ("a", 110.0), ("b", 0.0)]
    status = {r.payment_status: r.revenue for r in aggregates.revenue_by_payment_status(sales).collect()}
    assert status == {"failed": 200.0, "paid": 110.0, "pending": 50.0, "unknown": 0.0}
    risk = aggregates.revenue_at_risk(sales).first()
    assert risk.revenue_at_risk == 250.0 and risk.at_risk_pct == 69.4


@pytest.mark.parametrize("partitions", [1, 16])
def test_months_fill_gaps(sales_of, partitions):
    got = [tuple(r) for r in timeseries.monthly_revenue(sales_of(ROWS).repartition(partitions)).collect()]
    assert got == [(datetime.date(2024, 1, 31), 150.0), (datetime.date(2024, 2, 29), 0.0), (datetime.date(2024, 3, 31), 200.0)]


def test_growth_from_zero(sales_of):
    got = [r.growth for r in timeseries.monthly_growth(sales_of(ROWS)).collect()]
    assert got == [0.0, -1.0, float("inf")]
    stats = timeseries.growth_stats(timeseries.monthly_growth(sales_of(ROWS))).first()
    assert stats.positive_growth_months == 0 and stats.negative_growth_months == 1 and stats.max_growth == -1.0
    assert stats.latest_growth == float("inf") and stats.growth_volatility == 0.0


def test_declining(spark):
    cases = {(5, 4, 3): True, (5, 5): True, (5,): False, (): False, (3, 4): False, (5, 4, 5): False}
    frame = spark.createDataFrame([(list(map(float, k)), v) for k, v in cases.items()], "v array<double>, want boolean")
    assert all(r.got == r.want for r in frame.select("want", timeseries.is_declining(F.col("v")).alias("got")).collect())


def test_trends_keep_the_last_months(sales_of):
    rows = [(f"2024-{m:02d}-01", "a", "P", "R", 100 - m, 1, 1.0, "paid") for m in range(1, 9)]
    row = timeseries.monthly_revenue_by_product(sales_of(rows)).first()
    assert row.trend == [97.0, 96.0, 95.0, 94.0, 93.0, 92.0] and row.declining
    assert row.monthly_revenue["2024-01"] == 99.0 and len(row.monthly_revenue) == 8


def test_every_spike_is_kept(sales_of):
    rows = [(f"202{y}-{m:02d}-01", "a", "P", "R", 5000 if (y, m) in ((2, 3), (3, 7)) else 100, 1, 1.0, "paid") for y in (2, 3) for m in range(1, 13)]
    found = anomalies.revenue_anomalies(sales_of(rows)).collect()
    assert [r.month.month for r in found] == [3, 7] and all(r.kind == "spike" for r in found)
    assert found[0].text == "Revenue spike detected: $5,000 (vs average $508)"
    assert anomalies.product_anomalies(sales_of(rows)).count() == 2


def test_seasons(sales_of):
    factor = {1: 80, 7: 125}
    rows = [(f"202{y}-{m:02d}-01", "a", "P", "R", 1000 * factor.get(m, 100) / 100, 1, 1.0, "paid") for y in (2, 3, 4) for m in range(1, 13)]
    row = anomalies.seasonality(sales_of(rows)).first()
    assert row.has_seasonality and row.peak_month == "July" and row.trough_month == "January" and row.strength == 1.0
    short = anomalies.seasonality(sales_of(rows[:12])).first()
    assert not short.has_seasonality and short.months_available == 12 and short.strength is None


def test_interpolation(spark):
    d = datetime.date
    frame = spark.createDataFrame(
        [(d(2024, 1, 1), None), (d(2024, 2, 1), 10.0), (d(2024, 3, 1), None), (d(2024, 4, 1), 70.0), (d(2024, 5, 1), None)], "month date, revenue double"
    )
    got = [r.revenue for r in timeseries.interpolate_months(frame).orderBy("month").collect()]
    assert got == [None, 10.0, pytest.approx(10 + 60 * 29 / 60), 70.0, 70.0]


def test_registry(sales_of):
    registry = Registry()
    assert registry.run("compute_kpis", sales_of(ROWS)).first().total_revenue == 360.0
    registry.add("rows", lambda sales: sales.agg(F.count("*").alias("n")))
    assert registry.run("rows", sales_of(ROWS)).first().n == 5
    with pytest.raises(ValueError, match="unknown operator"):
        Registry().run("rows", sales_of(ROWS))


def test_report_reads_sales_once(sales_of):
    base = reports.report_base(sales_of(ROWS))
    assert base["months"].agg(F.sum("revenue")).first()[0] == base["product"].agg(F.sum("revenue")).first()[0]
    text = reports.summary_text(sales_of(ROWS)).first().summary
    assert text.startswith("Total revenue: $360, total cost: $185") and "Outstanding unpaid revenue: $250." in text
