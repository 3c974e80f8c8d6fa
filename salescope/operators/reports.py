"""Reports over several operators: summary text, overview, combined table, JSON-safe rows.

Combined results are long tables ``section, key, value, text``. A report reads the
sales once: :func:`report_base` sums them per customer and month, product, region
and payment status into a small stored table, and since sums of sums are the same
sums, every operator then runs on that table as if it were the sales.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    MapType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from salescope.functions.dates import month_of
from salescope.functions.fixed_values import SECTIONS_BY_TYPE
from salescope.functions.lookups import single_value
from salescope.functions.numbers import finite, half_even, plain_number
from salescope.functions.text import display_name, known
from salescope.operators import aggregates, anomalies, forecast, timeseries
from salescope.session import materialise


def _ranked_text(top: DataFrame, label: str) -> Column:
    """``name ($n), ...`` over an already limited frame, as one value."""
    item = F.struct((-F.col("revenue")).alias("r"), F.col(label).alias("n"))
    listed = F.transform(
        F.array_sort(F.collect_list(item)), lambda x: F.concat(x["n"], F.lit(" ($"), plain_number(-x["r"]), F.lit(")"))
    )
    return single_value(top, F.array_join(listed, ", "))


def report_base(sales: DataFrame) -> dict[str, DataFrame]:
    """Sales summed once, by part: ``months`` (customer and month), product (and month), region, payment_status.

    The sums are written to the shared folder, so the sections of a report neither
    rescan the sales nor depend on executors keeping a cache.
    """
    labels = {"product": "Unknown", "region": "Unknown", "payment_status": "unknown"}
    labels = {c: name for c, name in labels.items() if c in sales.columns}
    money = [c for c in ("revenue", "cost", "profit") if c in sales.columns]
    prepared = sales.select(
        known(F.col("customer")).alias("customer"),
        month_of(F.col("date")).alias("date"),
        *[known(F.col(c), name).alias(c) for c, name in labels.items()],
        *money,
        F.col("customer").isNull().alias("_nameless"),
    )
    part = F.coalesce(*[F.when(F.grouping(c) == 0, c) for c in labels], F.lit("months"))
    sets = [["customer", "date"], *[["product", "date"] if c == "product" else [c] for c in labels]]
    summed = prepared.groupingSets(sets, "customer", "date", *labels).agg(
        *[F.sum(c).alias(c) for c in money],
        F.count("revenue").alias("revenue_rows"),
        F.count("*").alias("rows"),
        F.count_if("_nameless").alias("nameless_rows"),
        part.alias("part"),
    )
    stored = materialise(summed, "report-base", partition_by=["part"])
    return {name: stored.where(F.col("part") == name) for name in ("months", *labels)}


def summary_text(sales: DataFrame) -> DataFrame:
    """One row of text: key figures, top customers, latest growth, anomalies, unpaid revenue."""
    base = report_base(sales)
    sales, statuses = base["months"], base.get("payment_status")
    figures = aggregates.kpis(sales)
    latest = timeseries.monthly_growth(sales)
    last_growth = single_value(latest, F.struct(F.max("month").alias("m"), F.max_by("growth", "month").alias("g")))
    unusual = single_value(anomalies.anomaly_count(sales), F.max("anomaly_count"))
    unpaid = (
        single_value(aggregates.outstanding_revenue(statuses), F.max("outstanding_revenue"))
        if statuses is not None
        else F.lit(0.0)
    )
    customers = _ranked_text(aggregates.top_by_revenue(sales, "customer", 3), "customer")
    gathered = figures.withColumns({"_growth": last_growth, "_unusual": unusual, "_unpaid": unpaid, "_top": customers})
    growth = F.bround(F.col("_growth.g") * 100, 0)
    lines = F.concat_ws(
        "",
        F.concat(
            F.lit("Total revenue: $"), plain_number(F.col("total_revenue")), F.lit(", total cost: $"),
            plain_number(F.col("total_cost")), F.lit(", total profit: $"), plain_number(F.col("total_profit")),
            F.lit(", profit margin: "), plain_number(F.col("profit_margin") * 100), F.lit("%.\n"),
        ),
        F.when(F.col("_top") != "", F.concat(F.lit("Top customers: "), F.col("_top"), F.lit(".\n"))),
        F.when(
            F.col("_growth.m").isNotNull(),
            F.concat(
                F.lit("Latest month ("), F.date_format("_growth.m", "MMMM yyyy"), F.lit(") growth: "),
                F.when(F.abs(growth) < 9e15, growth.cast("long").cast("string")).otherwise("inf"), F.lit("%.\n"),
            ),
        ),
        F.when(F.col("_unusual") > 0, F.lit("Revenue anomalies detected.\n")),
        F.when(F.col("_unpaid") > 0, F.concat(F.lit("Outstanding unpaid revenue: $"), plain_number(F.col("_unpaid")), F.lit(".\n"))),
    )
    return gathered.select(lines.alias("summary"))


def _rows(df: DataFrame, section: str, key: Column, value: Column | None = None, text: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def _figures(one_row: DataFrame, section: str | None = None) -> DataFrame:
    """A one-row frame as rows; each column its own section unless one is given."""
    textual = {f.name for f in one_row.schema.fields if f.dataType.simpleString() in ("string", "date", "boolean")}
    cells = F.array(
        *[
            F.struct(
                F.lit(section or c).alias("section"),
                F.lit(c).alias("key"),
                (F.lit(None) if c in textual else F.col(c)).cast("double").alias("value"),
                (F.col(c) if c in textual else F.lit(None)).cast("string").alias("text"),
            )
            for c in one_row.columns
        ]
    )
    return one_row.select(F.inline(cells))


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _overview_text(sales: DataFrame, products: DataFrame) -> DataFrame:
    """One sentence each on revenue, the top customer, the top product and anomalies."""

    def leader(source: DataFrame, dimension: str) -> Column:
        top = aggregates.top_by_revenue(source, dimension, 1)
        return single_value(top, F.struct(F.max(dimension).alias("n"), F.max("revenue").alias("r")))

    gathered = aggregates.kpis(sales).withColumns(
        {
            "_c": leader(sales, "customer"),
            "_p": leader(products, "product"),
            "_n": single_value(anomalies.anomaly_count(sales), F.max("anomaly_count")),
        }
    )
    percent = F.format_number(F.col("profit_margin") * 100, 1)
    return gathered.select(
        F.concat_ws(
            "",
            F.lit("Your business has generated $"), plain_number(F.col("total_revenue")), F.lit(" in revenue with a "), percent,
            F.lit("% profit margin. "),
            F.when(
                F.col("_c.n").isNotNull(),
                F.concat(F.lit("Your top customer is "), "_c.n", F.lit(" contributing $"), plain_number(F.col("_c.r")), F.lit(". ")),
            ),
            F.when(
                F.col("_p.n").isNotNull(),
                F.concat(F.lit("The best-selling product is "), "_p.n", F.lit(" with $"), plain_number(F.col("_p.r")), F.lit(" in revenue. ")),
            ),
            F.when(
                F.col("_n") > 0,
                F.concat(F.lit("We detected "), F.col("_n").cast("string"), F.lit(" revenue anomalies that may need investigation.")),
            ).otherwise("No significant revenue anomalies were detected."),
        ).alias("text")
    )


def overview(sales: DataFrame) -> DataFrame:
    """Key figures, five best customers and products, months, anomalies and text.

    Both top lists are filled; testing a series for being a dictionary would leave
    them empty.
    """
    base = report_base(sales)
    sales, products = base["months"], base["product"]
    return _stack(
        [
            _figures(aggregates.kpis(sales), "kpis"),
            _rows(aggregates.top_by_revenue(sales, "customer"), "top_customers", F.col("customer"), F.col("revenue")),
            _rows(aggregates.top_by_revenue(products, "product"), "top_products", F.col("product"), F.col("revenue")),
            _rows(timeseries.monthly_revenue(sales), "monthly_trend", F.col("month"), F.col("revenue")),
            _rows(anomalies.revenue_anomalies(sales), "anomalies", F.col("month"), F.col("revenue"), F.col("text")),
            _rows(_overview_text(sales, products), "summary", F.lit("text"), text=F.col("text")),
        ]
    )


def _forecast_sections(sales: DataFrame, products: DataFrame, steps: int) -> list[tuple[str, Callable[[], DataFrame]]]:
    """Sections that rest on forecasts, each built only when it is asked for."""
    total = forecast.total_series(sales)
    month = F.date_format("month", "yyyy-MM")

    @cache
    def by_product() -> DataFrame:
        return materialise(forecast.product_forecasts(products, steps), "product-forecasts")

    def bounds() -> DataFrame:
        found = forecast.forecast_with_bounds(total, steps)
        return _stack([_rows(found, "confidence_forecast", F.concat(month, F.lit(f" {c}")), F.col(c), F.col("method")) for c in ("forecast", "lower", "upper")])

    def summary() -> DataFrame:
        known_sums = by_product().groupBy("product", "method").agg(F.max("forecast_sum").alias("total"))
        joined = known_sums.join(forecast.forecast_trends(by_product()), "product")
        return _rows(joined, "forecast_summary", display_name(F.col("product")), F.col("total"), F.concat_ws(", ", "method", "trend"))

    top = lambda: forecast.top_product(by_product())
    return [
        ("product_forecast", lambda: _rows(by_product().where("step IS NOT NULL"), "product_forecast", F.col("product"), F.col("forecast"), F.col("month_name"))),
        ("forecast_summary", summary),
        ("overall_forecast", lambda: _rows(forecast.revenue_forecast(total, steps), "overall_forecast", month, F.col("forecast"), F.col("method"))),
        ("confidence_forecast", bounds),
        ("ensemble_forecast", lambda: _rows(forecast.ensemble_forecast(total, steps), "ensemble_forecast", month, F.col("ensemble"))),
        ("top_product_forecast", lambda: _rows(top(), "top_product_forecast", F.lit("top_product_forecast"), text=F.col("product"))),
        ("top_product_forecast_value", lambda: _rows(top(), "top_product_forecast_value", F.lit("top_product_forecast_value"), F.col("forecast"))),
    ]


def combined_metrics(sales: DataFrame, sections: Sequence[str] | None = None, forecasts: bool = False, steps: int = 3) -> DataFrame:
    """Metrics handed to an insight writer, as one long table; only the wanted ``sections``, if given.

    Without ``sections`` those that fit forecasting models come only with ``forecasts``. Sums of unpaid
    revenue are called ``failed_revenue`` and ``pending_revenue``, as they are no counts.
    """
    base = report_base(sales)
    sales, products, regions, statuses = (base[p] for p in ("months", "product", "region", "payment_status"))
    months_only = materialise(
        sales.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("revenue", "cost", "profit", "revenue_rows", "rows", "nameless_rows")]), "report-months"
    )
    growth = timeseries.monthly_growth(months_only)
    profit = timeseries.monthly_profit(months_only)
    nameless = F.sum("nameless_rows")
    month = F.date_format("month", "yyyy-MM")

    @cache
    def customer_trends() -> DataFrame:
        return timeseries.monthly_revenue_by_customer(sales)

    def monthly(name: str, key: Column, of: DataFrame, entity: str, unknown: bool) -> DataFrame:
        return _rows(timeseries.entity_months(of, entity, unknown), name, key, F.col("revenue"), month)

    missing = lambda: months_only.agg(
        nameless.alias("missing_customers"), F.when(nameless > 0, half_even(nameless * 100 / F.sum("rows"), 1)).alias("missing_customers_percentage")
    )
    risk = lambda: aggregates.revenue_at_risk(statuses).select(
        "failed_revenue", "pending_revenue", "revenue_at_risk", F.col("at_risk_pct").alias("revenue_at_risk_percentage")
    )
    stats = lambda: timeseries.growth_stats(growth).withColumnRenamed("latest_month", "latest_growth_month")
    product, raw = display_name(F.col("product")), F.col("product")
    figures = [
        (("total_revenue", "total_cost", "total_profit", "profit_margin", "avg_order_value"), lambda: aggregates.kpis(months_only)),
        (("positive_growth_months", "negative_growth_months", "max_growth", "min_growth", "avg_growth", "growth_volatility", "latest_growth", "latest_growth_month"), stats),
        (("failed_revenue", "pending_revenue", "revenue_at_risk", "revenue_at_risk_percentage"), risk),
        (("missing_customers", "missing_customers_percentage"), missing),
        (("revenue_concentration",), lambda: aggregates.revenue_concentration(sales).select(F.col("concentration_pct").alias("revenue_concentration"))),
        (("profit_trend",), lambda: timeseries.profit_trend(profit).select(F.col("trend").alias("profit_trend"))),
        (("declining_customers_count",), lambda: customer_trends().agg(F.count_if("declining").alias("declining_customers_count"))),
        (("anomaly_count",), lambda: anomalies.anomaly_count(months_only)),
    ]
    lists = [
        ("monthly_growth", lambda: _rows(growth, "monthly_growth", F.col("month"), F.col("growth"))),
        ("monthly_profit", lambda: _rows(profit, "monthly_profit", F.col("month"), F.col("profit"))),
        ("product_monthly_trends", lambda: monthly("product_monthly_trends", F.concat(product, F.lit("_monthly_trend")), products, "product", False)),
        ("monthly_revenue_by_product_raw", lambda: monthly("monthly_revenue_by_product_raw", raw, products, "product", False)),
        ("revenue_by_product", lambda: _rows(aggregates.revenue_by(products, "product"), "revenue_by_product", product, F.col("revenue"))),
        ("revenue_by_product_raw", lambda: _rows(aggregates.revenue_by(products, "product"), "revenue_by_product_raw", raw, F.col("revenue"))),
        ("revenue_by_region", lambda: _rows(aggregates.revenue_by(regions, "region"), "revenue_by_region", F.col("region"), F.col("revenue"))),
        ("top_regions", lambda: _rows(aggregates.top_by_revenue(regions, "region"), "top_regions", F.col("region"), F.col("revenue"))),
        ("revenue_by_customer_raw", lambda: _rows(aggregates.revenue_by(sales, "customer"), "revenue_by_customer_raw", F.col("customer"), F.col("revenue"))),
        ("top_customers", lambda: _rows(aggregates.top_by_revenue(sales, "customer"), "top_customers", F.col("customer"), F.col("revenue"))),
        ("customer_monthly_trends", lambda: monthly("customer_monthly_trends", F.col("customer"), sales, "customer", True)),
        ("declining_customers", lambda: _rows(customer_trends().where("declining"), "declining_customers", F.col("customer"))),
        ("payment_status_counts", lambda: _rows(aggregates.revenue_by_payment_status(statuses), "payment_status_counts", F.col("payment_status"), F.col("revenue"))),
        ("anomalies", lambda: _rows(anomalies.revenue_anomalies(months_only), "anomalies", F.col("month"), F.col("revenue"), F.col("text"))),
    ]
    fitted = _forecast_sections(months_only, products, steps) if forecasts or sections is not None else []
    wanted = lambda names: sections is None or not set(names).isdisjoint(sections)
    parts = [_figures(build()) for names, build in figures if wanted(names)] + [build() for name, build in lists + fitted if wanted([name])]
    if not parts:
        raise ValueError(f"no such sections: {sections}")
    stacked = _stack(parts)
    return stacked if sections is None else stacked.where(F.col("section").isin(*sections))


def sections_for(sales: DataFrame, question_type: str, steps: int = 3) -> DataFrame:
    """The sections that matter to a question type, and no others built; types without a list get everything."""
    wanted = SECTIONS_BY_TYPE.get(question_type)
    return combined_metrics(sales, wanted, forecasts=True, steps=steps)


def _safe(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return finite(value)
    if isinstance(kind, DateType):
        return value.cast("string")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    if isinstance(kind, StructType):
        inner = F.struct(*[_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: _safe(v, kind.valueType))
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text: NaN and infinities null, times in ISO form, nested values too."""
    fields = [_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
