import datetime

import pytest

from salescope.operators import mapping, quality
from salescope.operators.mapping import MappingConfig


def test_names_map():
    names = ["Date", "Customer", "Product", "Region", "Revenue", "Currency", "Quantity", "Payment Status", "Notes"]
    match = mapping.match_columns(names)
    assert list(match.mapping.values()) == ["date", "customer", "product", "region", "revenue", "currency", "quantity", "payment_status", "notes"]
    assert match.unmapped == [] and match.warnings == []


def test_other_names_map():
    match = mapping.match_columns(["transaction_date", "client", "sales_region", "amount", "curr", "units", "status", "zzz"])
    assert match.mapping["transaction_date"] == "date" and match.mapping["client"] == "customer"
    assert match.mapping["amount"] == "revenue" and match.mapping["units"] == "quantity"
    assert "zzz" in match.unmapped and "zzz" in match.warnings[0]


def test_a_standard_is_used_once():
    match = mapping.match_columns(["revenue", "sales"])
    assert match.mapping == {"revenue": "revenue"} and match.unmapped == ["sales"]


def test_config_is_not_shared():
    more = MappingConfig().with_variants("revenue", ["umsatz"])
    assert mapping.match_columns(["umsatz"], more).mapping == {"umsatz": "revenue"}
    assert mapping.match_columns(["umsatz"]).mapping == {}
    with pytest.raises(KeyError):
        MappingConfig().with_variants("nothing", ["x"])


def test_acceptability():
    assert mapping.schema_is_acceptable(mapping.match_columns(["date", "revenue"]))[0]
    assert not mapping.schema_is_acceptable(mapping.match_columns(["date", "cost"]))[0]
    assert not mapping.schema_is_acceptable(mapping.match_columns(["date", "revenue", "qqqq", "wwww"]))[0]


def test_conversion(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "1000", "400", "USD"), ("2024-01-02", "2417", "1200", "EUR"), ("2024-01-03", "880100", "1", "JPY"), ("bad", "n/a", "5", None)],
        "date string, revenue string, cost string, currency string",
    )
    mapped = mapping.map_schema(raw).sales.orderBy("revenue_original").collect()
    by_original = {r.revenue_original: r for r in mapped}
    assert float(by_original["2417"].revenue) == pytest.approx(2852.06, abs=0.011)
    assert float(by_original["2417"].cost) == 1416.0
    assert by_original["2417"].revenue_original_currency == "EUR"
    assert by_original["n/a"].revenue is None and by_original["n/a"].profit is None and by_original["n/a"].date is None
    assert float(by_original["1000"].profit) == 600.0
    assert by_original["1000"].date == datetime.date(2024, 1, 1)
    summary = {r.currency: r for r in mapping.conversion_summary(mapping.map_schema(raw).sales).collect()}
    assert summary["all"].total_rows == 4 and summary["all"].cells_converted == 4 and summary["all"].cells_unparsable == 1


def test_no_currency_column_means_target(spark):
    raw = spark.createDataFrame([("2024-01-01", 10.0)], "date string, revenue double")
    row = mapping.map_schema(raw).sales.first()
    assert row.currency == "USD" and float(row.revenue) == 10.0 and row.cost is None


def test_separators_and_large_amounts(spark):
    raw = spark.createDataFrame(
        [("1,234.56", "USD"), ("1.234,56", "USD"), ("1234.56", "USD"), ("$1,000,000,000", "USD"), ("€2,000,000,000", "EUR")],
        "revenue string, currency string",
    )
    got = sorted(float(r.revenue) for r in mapping.map_schema(raw).sales.collect())
    assert got[:3] == [1234.56] * 3 and got[3] == 1e9 and got[4] == pytest.approx(2.36e9, abs=0.02)


def test_mapper_is_one_narrow_stage(spark):
    raw = spark.createDataFrame([("2024-01-01", "1", "EUR", "x")], "date string, revenue string, currency string, junk string")
    plan = mapping.map_schema(raw).sales._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_quality(spark):
    rows = [("2024-01-01", "1", "a"), ("nope", "x", None), (None, None, "c"), ("2024-01-02", "2", "d")]
    report = {(r.check, r.column): r for r in quality.quality_report(spark.createDataFrame(rows, "DATE string, Revenue string, customer string")).collect()}
    assert report["row_count", None].value == 4 and not report["row_count", None].passed
    assert report["invalid_dates", "DATE"].value == 2
    assert report["non_numeric", "Revenue"].value == 2
    assert report["missing_customers_pct", "customer"].value == 25.0
    assert report["max_text_length", "DATE"].value == 10


def test_schema_gate(spark):
    with pytest.raises(ValueError, match="revenue"):
        quality.check_schema(spark.createDataFrame([], "date string, other string"))
    assert quality.check_schema(spark.createDataFrame([], "DATE string, REVENUE double")) == {"date": "DATE", "revenue": "REVENUE"}
    with pytest.raises(ValueError, match="columns"):
        quality.check_schema(spark.createDataFrame([], "date string, revenue double"), max_columns=1)
