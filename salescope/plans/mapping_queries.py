"""Schema mapping, currency conversion and data quality over raw order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.functions.dates import parse_date
from salescope.functions.fixed_values import RATES_TO_USD
from salescope.functions.money import bare_money_text, currency_code, money_value
from salescope.operators import mapping, quality
from salescope.plans.tables import over_sales, sales, table

QUERIES = {}
ORACLES = {}


def _add(name, query, sql):
    QUERIES[name] = query
    ORACLES[name] = sql


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a foreign export: odd names, money as text in several styles."""
    rows = sales(spark, sf_dir, ["date", "customer", "brand", "region", "revenue", "cost", "currency", "quantity", "payment_status"])
    us = F.format_number("revenue", 2)
    european = F.translate(us, ",.", ".,")
    style = F.floor("quantity").cast("int") % 5
    amount = (
        F.when(style == 0, F.concat(F.lit("$"), us))
        .when(style == 1, european)
        .when(style == 2, F.concat(F.col("revenue").cast("string"), F.lit(" €")))
        .when(style == 3, F.lit("n/a"))
        .otherwise(F.replace(F.format_number("revenue", 0), F.lit(" "), F.lit("")))
    )
    spelled = (
        F.when(F.col("currency") == "USD", "US Dollar")
        .when(F.col("currency") == "EUR", "€")
        .when(F.col("currency") == "GBP", " pounds ")
        .otherwise("jpy")
    )
    return rows.select(
        F.col("date").cast("string").alias("Transaction_Date"),
        F.col("customer").alias("Client"),
        F.col("brand").alias("SKU"),
        F.col("region").alias("Market"),
        amount.alias("Amount"),
        F.col("cost").cast("string").alias("COGS"),
        spelled.alias("Curr"),
        F.col("quantity").cast("string").alias("Qty"),
        F.col("payment_status").alias("Pay Status"),
        F.lit("x").alias("Warehouse Bin"),
    )


_RATE = "CASE code " + " ".join(f"WHEN '{c}' THEN {r}::DOUBLE" for c, r in RATES_TO_USD.items()) + " END"
RAW_SQL = """
, styled AS (SELECT *, CAST(floor(quantity) AS INTEGER) % 5 AS style, currency AS code FROM sales)
, raw AS (SELECT *,
    CASE style WHEN 0 THEN '$' || format('{:,.2f}', CAST(revenue AS DOUBLE))
               WHEN 1 THEN translate(format('{:,.2f}', CAST(revenue AS DOUBLE)), ',.', '.,')
               WHEN 2 THEN CAST(revenue AS VARCHAR) || ' €'
               WHEN 3 THEN 'n/a'
               ELSE format('{:,}', CAST(round_even(CAST(revenue AS DOUBLE), 0) AS BIGINT)) END AS amount
  FROM styled)
, parsed AS (SELECT *, CASE style WHEN 3 THEN NULL WHEN 4 THEN round_even(CAST(revenue AS DOUBLE), 0) ELSE CAST(revenue AS DOUBLE) END AS money FROM raw)
, mapped AS (SELECT *,
    CAST(floor(CASE code WHEN 'USD' THEN money ELSE money * RATE END * 100) / 100 AS DECIMAL(18,2)) AS usd_revenue,
    CAST(floor(CASE code WHEN 'USD' THEN CAST(cost AS DOUBLE) ELSE CAST(cost AS DOUBLE) * RATE END * 100) / 100 AS DECIMAL(18,2)) AS usd_cost
  FROM parsed)
""".replace("RATE", _RATE)


def _mapped(spark, sf_dir):
    return mapping.map_schema(raw_sales(spark, sf_dir)).sales


_add(
    "mapped_sales",
    lambda s, d: _mapped(s, d).select(
        "date", "customer", "product", "region", F.col("revenue").cast("double").alias("revenue"),
        F.col("cost").cast("double").alias("cost"), "currency", "quantity", "payment_status", "notes",
        F.col("profit").cast("double").alias("profit"), "revenue_original", "revenue_original_currency",
        "cost_original", "cost_original_currency", "monetary_values_in_usd",
    ),
    over_sales(RAW_SQL + """
SELECT date, customer, brand AS product, region, CAST(usd_revenue AS DOUBLE) AS revenue, CAST(usd_cost AS DOUBLE) AS cost,
       code AS currency, quantity, payment_status, CAST(NULL AS VARCHAR) AS notes,
       CAST(usd_revenue - usd_cost AS DOUBLE) AS profit, amount AS revenue_original, code AS revenue_original_currency,
       CAST(cost AS VARCHAR) AS cost_original, code AS cost_original_currency, true AS monetary_values_in_usd
FROM mapped"""),
)
_add(
    "conversion_summary",
    lambda s, d: mapping.conversion_summary(_mapped(s, d)),
    over_sales(RAW_SQL + """
SELECT coalesce(code, 'all') AS currency, count(*) AS total_rows,
       count(*) FILTER (code <> 'USD' AND usd_revenue IS NOT NULL) + count(*) FILTER (code <> 'USD' AND usd_cost IS NOT NULL) AS cells_converted,
       count(*) FILTER (style = 3) AS cells_unparsable
FROM mapped GROUP BY ROLLUP (code)"""),
)
_add(
    "unparsable_values",
    lambda s, d: mapping.unparsable_values(_mapped(s, d)).groupBy("column", "value").agg(F.count("*").alias("rows")),
    over_sales(RAW_SQL + "SELECT 'revenue' AS \"column\", amount AS value, count(*) AS rows FROM mapped WHERE style = 3 GROUP BY 2"),
)
_add(
    "money_text_values",
    lambda s, d: raw_sales(s, d).select("Amount", bare_money_text(F.col("Amount")).alias("bare")).select("Amount", money_value(F.col("bare")).alias("value")).groupBy("Amount").agg(
        F.max("value").alias("value"), F.count("*").alias("rows")
    ),
    over_sales(RAW_SQL + 'SELECT amount AS "Amount", max(money) AS value, count(*) AS rows FROM parsed GROUP BY 1'),
)
_add(
    "currency_codes",
    # Customer names and segments pad the list with values that are no currency.
    lambda s, d: table(s, d, "customer")
    .select(
        F.when(F.col("c_nationkey") % 6 == 0, "₹")
        .when(F.col("c_nationkey") % 6 == 1, "eur ")
        .when(F.col("c_nationkey") % 6 == 2, "Pound Sterling")
        .when(F.col("c_nationkey") % 6 == 3, F.col("c_mktsegment"))
        .when(F.col("c_nationkey") % 6 == 4, "Indian rupee")
        .alias("raw")
    )
    .groupBy("raw")
    .agg(F.count("*").alias("rows"))
    .select("raw", currency_code(F.col("raw")).alias("code"), "rows"),
    """
, keyed AS (SELECT CASE c_nationkey % 6 WHEN 0 THEN '₹' WHEN 1 THEN 'eur ' WHEN 2 THEN 'Pound Sterling' WHEN 3 THEN c_mktsegment
                        WHEN 4 THEN 'Indian rupee' END AS raw FROM customer)
SELECT raw, CASE WHEN raw IS NULL THEN 'USD' WHEN raw = '₹' THEN 'INR' WHEN raw = 'eur ' THEN 'EUR' WHEN raw = 'Pound Sterling' THEN 'GBP'
     WHEN raw = 'Indian rupee' THEN 'INR' WHEN starts_with(raw, 'US') OR contains(raw, 'DOLLAR') THEN 'USD'
     WHEN starts_with(raw, 'EU') THEN 'EUR' WHEN starts_with(raw, 'GB') THEN 'GBP' WHEN starts_with(raw, 'JP') OR contains(raw, 'YEN') THEN 'JPY'
     WHEN starts_with(raw, 'IN') THEN 'INR' ELSE 'USD' END AS code, count(*) AS rows
FROM keyed GROUP BY 1, 2""".replace(", keyed", "WITH keyed", 1),
)
_add(
    "completed_columns",
    lambda s, d: mapping.add_missing_columns(
        mapping.rename_to_standard(sales(s, d, ["date", "revenue", "region"]).withColumnRenamed("region", "territory"))
    ).withColumn("revenue", F.col("revenue").cast("double")),
    over_sales("""
SELECT date, CAST(NULL AS VARCHAR) AS customer, CAST(NULL AS VARCHAR) AS product, region, CAST(revenue AS DOUBLE) AS revenue,
       CAST(NULL AS VARCHAR) AS cost, 'USD' AS currency, CAST(NULL AS VARCHAR) AS quantity, CAST(NULL AS VARCHAR) AS payment_status,
       CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS profit FROM sales"""),
)


def _untyped(spark, sf_dir):
    """Sales with some dates and numbers spoiled."""
    q = F.floor("quantity").cast("int")
    return sales(spark, sf_dir, ["date", "customer", "revenue", "cost", "quantity"]).select(
        F.when(q % 7 == 0, "not a date").when(q % 7 == 1, F.date_format("date", "yyyy-MM")).otherwise(F.col("date").cast("string")).alias("DATE"),
        F.col("customer").alias("Customer"),
        F.when(q % 11 == 0, "one thousand").otherwise(F.col("revenue").cast("string")).alias("Revenue"),
        F.col("cost").cast("string").alias("cost"),
        F.when(q % 13 != 0, F.col("quantity").cast("string")).alias("quantity"),
    )


_UNTYPED_SQL = """
, u AS (SELECT CAST(floor(quantity) AS INTEGER) AS q, * FROM sales)
, typed AS (SELECT CASE q % 7 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('month', date)::DATE ELSE date END AS d, customer,
                   CASE WHEN q % 11 <> 0 THEN CAST(revenue AS DOUBLE) END AS r, CAST(cost AS DOUBLE) AS c,
                   CASE WHEN q % 13 <> 0 THEN quantity END AS n, q FROM u)
"""


def _coerced(spark, sf_dir):
    raw = _untyped(spark, sf_dir)
    typed = mapping.coerce_types(raw.toDF(*[c.lower() for c in raw.columns]))
    return typed.select("date", "customer", *[F.col(c).cast("double").alias(c) for c in ("revenue", "cost", "quantity", "profit")])


_add(
    "coerced_types",
    _coerced,
    over_sales(_UNTYPED_SQL + """
SELECT d AS date, customer, r AS revenue, c AS cost, n AS quantity,
       CAST(CAST(r AS DECIMAL(18,2)) - CAST(c AS DECIMAL(18,2)) AS DOUBLE) AS profit FROM typed"""),
)
_add(
    "quality_report",
    lambda s, d: quality.quality_report(_untyped(s, d)),
    over_sales(_UNTYPED_SQL + """
, t AS (SELECT count(*) AS n, count(*) FILTER (d IS NULL) AS bad_d, count(*) FILTER (r IS NULL) AS bad_r,
   max(length(CASE q % 7 WHEN 0 THEN 'not a date' WHEN 1 THEN 'yyyy-MM' ELSE 'yyyy-MM-dd' END)) AS ld, max(length(customer)) AS lc,
   max(CASE WHEN q % 11 = 0 THEN 12 ELSE length(CAST(CAST(r AS DECIMAL(18,2)) AS VARCHAR)) END) AS lr,
   max(length(CAST(CAST(c AS DECIMAL(18,2)) AS VARCHAR))) AS lk, max(length(CAST(n AS VARCHAR))) AS lq,
   count(*) FILTER (customer IS NULL) AS nc FROM typed)
SELECT 'row_count' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(n AS DOUBLE) AS value, n >= 5 AS passed FROM t
UNION ALL SELECT 'invalid_dates', 'DATE', bad_d, bad_d = 0 FROM t
UNION ALL SELECT 'non_numeric', 'Revenue', bad_r, bad_r = 0 FROM t
UNION ALL SELECT 'max_text_length', 'DATE', ld, ld <= 10000 FROM t
UNION ALL SELECT 'max_text_length', 'Customer', lc, lc <= 10000 FROM t
UNION ALL SELECT 'max_text_length', 'Revenue', lr, lr <= 10000 FROM t
UNION ALL SELECT 'max_text_length', 'cost', lk, lk <= 10000 FROM t
UNION ALL SELECT 'max_text_length', 'quantity', lq, lq <= 10000 FROM t
UNION ALL SELECT 'missing_customers', 'Customer', nc, true FROM t
UNION ALL SELECT 'missing_customers_pct', 'Customer', round_even(nc * 100 / n, 1), true FROM t"""),
)
_add(
    "parsed_dates",
    lambda s, d: table(s, d, "orders")
    .select(
        F.when(F.col("o_custkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM"))
        .when(F.col("o_custkey") % 5 == 1, F.date_format("o_orderdate", "MMM yyyy"))
        .when(F.col("o_custkey") % 5 == 2, F.date_format("o_orderdate", "MMMM yyyy"))
        .when(F.col("o_custkey") % 5 == 3, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.col("o_orderpriority"))
        .alias("text")
    )
    .groupBy("text")
    .agg(F.count("*").alias("rows"))
    .select("text", parse_date(F.col("text")).alias("day"), "rows"),
    """
WITH t AS (SELECT CASE o_custkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%b %Y')
   WHEN 2 THEN strftime(o_orderdate, '%B %Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE o_orderpriority END AS text,
   CASE WHEN o_custkey % 5 < 3 THEN date_trunc('month', o_orderdate)::DATE WHEN o_custkey % 5 = 3 THEN o_orderdate::DATE END AS day FROM orders)
SELECT text, day, count(*) AS rows FROM t GROUP BY 1, 2""",
)

# Each form of a date with its DuckDB format and, for the sake of the other order, whether the day comes first.
_FORMS = [
    ("yyyy/M/d", "%Y/%-m/%-d", False), ("M/d/yyyy", "%-m/%-d/%Y", False), ("d/M/yyyy", "%-d/%-m/%Y", True), ("MMM d, yyyy", "%b %-d, %Y", False),
    ("d MMM yyyy", "%-d %b %Y", False), ("MMMM d, yyyy", "%B %-d, %Y", False), ("yyyyMMdd", "%Y%m%d", False), ("M/d/yy", "%-m/%-d/%y", False),
    ("dd.MM.yyyy", "%d.%m.%Y", True), ("MM-dd-yyyy HH:mm", "%m-%d-%Y %H:%M", False), ("yyyy-MM-dd", "%Y-%m-%d", False),
    ("dd-MMM-yyyy", "%d-%b-%Y", False), ("EEE MMM d yyyy", "%a %b %-d %Y", False), ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y", False),
    ("EEE MMM dd HH:mm:ss yyyy", "%a %b %d %H:%M:%S %Y", False), ("d-MMM-yy", "%-d-%b-%y", False), ("yyyy-MMM-dd", "%Y-%b-%d", False),
]


def _date_forms(spark, sf_dir):
    """Order dates written in seventeen forms and read again; the day comes first in two of them."""
    orders = table(spark, sf_dir, "orders").withColumn("form", (F.col("o_orderkey") % len(_FORMS)).cast("int"))
    text, day = F.lit(None).cast("string"), F.lit(None).cast("date")
    for number, (fmt, _, _) in enumerate(_FORMS):
        text = F.when(F.col("form") == number, F.date_format("o_orderdate", fmt)).otherwise(text)
    written = orders.select("o_orderkey", "form", text.alias("text"))
    first = F.col("form").isin([n for n, f in enumerate(_FORMS) if f[2]])
    day = F.when(first, parse_date(F.col("text"), day_first=True)).otherwise(parse_date(F.col("text")))
    return written.select("o_orderkey", "text", day.alias("day"))


_add(
    "date_forms",
    _date_forms,
    "SELECT o_orderkey, CASE o_orderkey % "
    + str(len(_FORMS))
    + " ".join(f" WHEN {n} THEN strftime(o_orderdate, '{f[1]}')" for n, f in enumerate(_FORMS))
    + " END AS text, CAST(o_orderdate AS DATE) AS day FROM orders",
)


def _acceptable(spark, sf_dir):
    """Which tables could be taken as sales, as they are and with names added to the variants."""
    names = {"Ship Day": "date", "Extended": "revenue"}
    extended = mapping.MappingConfig()
    for name, standard in names.items():
        extended = extended.with_variants(standard, [name])
    orders = table(spark, sf_dir, "orders")
    shown = orders.select(F.col("o_orderdate").alias("Ship Day"), F.col("o_totalprice").alias("Extended"))
    cases = {
        "known names": (orders.select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("revenue")), mapping.MappingConfig()),
        "own names": (shown, mapping.MappingConfig()), "own names added": (shown, extended),
        "too many unknown": (orders.withColumnsRenamed({"o_orderdate": "date", "o_totalprice": "revenue"}), mapping.MappingConfig()),
    }
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("case"), F.lit(mapping.schema_is_acceptable(mapping.match_columns(df.columns, config))[0]).alias("acceptable"), "rows")
        for name, (df, config) in cases.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_add(
    "schema_acceptability",
    _acceptable,
    "SELECT c AS \"case\", a AS acceptable, n AS rows FROM (SELECT count(*) AS n FROM orders), "
    "(VALUES ('known names', true), ('own names', false), ('own names added', true), ('too many unknown', false)) v(c, a)",
)
