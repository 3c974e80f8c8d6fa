import datetime

import pytest
from pyspark.sql import functions as F

from salescope.functions.dates import parse_date
from salescope.functions.money import bare_money_text, currency_code, money_value, rate_to
from salescope.functions.numbers import floor_cents, floor_double, half_even
from salescope.functions.text import display_name, known
from salescope.sources.sheets import cell_number


def apply(spark, function, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_money_text(spark):
    cases = {
        "$8,748.00": 8748.0, "€2,417.00": 2417.0, "¥880,100": 880100.0, "1,234.56": 1234.56, "1000": 1000.0, None: None,
        "invalid": None, "1.234,56": 1234.56, "2,417 €": 2417.0, "1,23": 1.23, "1,234,567": 1234567.0, "-5": -5.0,
        "1e3": 1000.0, "10d": None, "": None, "1,234,56": None, "$1,000,000,000": 1e9,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string").withColumn("bare", bare_money_text(F.col("v")))
    got = {r.v: r.out for r in frame.select("v", money_value(F.col("bare")).alias("out")).collect()}
    assert got == cases


def test_currency_codes(spark):
    cases = {
        "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "EUR": "EUR", "cad": "CAD", "US Dollar": "USD",
        "EURO": "EUR", "POUNDS": "GBP", "YEN": "JPY", None: "USD", "whatever": "USD", " gbp ": "GBP",
    }
    assert apply(spark, currency_code, list(cases)) == list(cases.values())


def test_cross_rates(spark):
    assert apply(spark, lambda c: rate_to(c, "EUR"), ["USD", "EUR", "XXX"]) == [pytest.approx(1 / 1.18), 1.0, 1.0]


def test_rounding(spark):
    assert apply(spark, floor_double, [1.9, -1.1, None, float("inf"), 1e300], "double") == [1.0, -2.0, None, float("inf"), 1e300]
    assert apply(spark, floor_cents, [1.239, -0.001], "double") == [1.23, -0.01]
    assert apply(spark, lambda c: half_even(c, 1), [0.25, 0.35, 12.5], "double") == [0.2, 0.4, 12.5]


def test_dates(spark):
    cases = {
        "2024-01": (2024, 1, 1), "2024-01-15": (2024, 1, 15), "Jan 2024": (2024, 1, 1), "January 2024": (2024, 1, 1),
        "2024-02-03 10:11:12": (2024, 2, 3), "someday": None, None: None, "2024-13-01": None,
    }
    want = [datetime.date(*v) if v else None for v in cases.values()]
    assert apply(spark, parse_date, list(cases)) == want


def test_named_dates(spark):
    cases = [
        ("15-Jan-2024", (2024, 1, 15)), ("15/Jan/2024", (2024, 1, 15)), ("15 Jan 24", (2024, 1, 15)), ("15-jan-75", (1975, 1, 15)),
        ("Jan-24", (2024, 1, 1)), ("Jan'24", (2024, 1, 1)), ("Jan 24", None), ("Jan-2024", (2024, 1, 1)), ("2024 January", (2024, 1, 1)),
        ("15 Sept 2024", (2024, 9, 15)), ("Sept. 2024", (2024, 9, 1)), ("Mon Jan 15 2024", (2024, 1, 15)),
        ("Monday, January 15, 2024", (2024, 1, 15)), ("Mon, 15 Jan 2024 10:00:00 GMT", (2024, 1, 15)),
        ("Mon Jan 15 10:00:00 2024", (2024, 1, 15)), ("Mon Jan 15 10:00:00 UTC 2024", (2024, 1, 15)), ("Jan 15th, 2024", (2024, 1, 15)),
        ("2024-Jan-15", (2024, 1, 15)), ("31-Feb-2024", None), ("3-MEDIUM", None), ("Wednesday", None), ("Abc 2024", None), ("", None),
    ]
    want = [datetime.date(*day) if day else None for _, day in cases]
    assert apply(spark, parse_date, [text for text, _ in cases]) == want


def test_labels(spark):
    assert apply(spark, known, [None, "", " ", "a"]) == ["Unknown", "Unknown", " ", "a"]
    assert apply(spark, display_name, ["Premium Plan", "Basic_Plan", "ProPlan"]) == ["Premium Plan", "Basic Plan", "Pro Plan"]


def test_sheet_numbers(spark):
    assert apply(spark, cell_number, ["$1,234.5", "-3", "1-2", "abc", "", None]) == [1234.5, -3.0, None, None, None, None]
