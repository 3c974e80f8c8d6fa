"""Metric and insight rows from stored result JSON.

Each history row is parsed once and exploded once; nothing is unioned or rescanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.dates import parse_date
from salescope.functions.fixed_values import DEFAULT_ANSWER, INSIGHT_CONFIDENCE, KPI_CATEGORIES, SUMMARY_CHARS

_VALUES = "map<string,variant>"
_METRIC = "struct<metric_type:string,metric_value:double,category:string,category_name:string,metric_date:date>"
_INSIGHT = "struct<insight_text:string,insight_type:string,confidence_score:double>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")


def _is(value: Column, prefix: str) -> Column:
    return F.startswith(_kind(value), F.lit(prefix))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def _metric(kind: Column, value: Column, category: str, name: Column, date: Column) -> Column:
    return F.struct(
        kind.alias("metric_type"), value.alias("metric_value"), F.lit(category).alias("category"),
        name.cast("string").alias("category_name"), date.cast("date").alias("metric_date"),
    ).cast(_METRIC)


def _per_label(section: str, category: str) -> Column:
    """Scalar values, or the total of nested ones; other shapes are passed over."""

    def value(entry: Column) -> Column:
        number = F.when(_is_number(entry["value"]), F.try_variant_get(entry["value"], "$", "double"))
        nested = F.when(_is(entry["value"], "OBJECT"), F.try_variant_get(entry["value"], "$.total_revenue", "double"))
        return F.coalesce(number, nested)

    entries = F.filter(F.map_entries(F.col(f"_r.{section}")), lambda e: value(e).isNotNull())
    null = F.lit(None)
    return F.coalesce(
        F.transform(entries, lambda e: _metric(F.lit("revenue"), value(e), category, e["key"], null)), _empty(_METRIC)
    )


def extract_metrics(history: DataFrame, raw: str = "raw_results") -> DataFrame:
    """``analysis_id`` and metric rows from result JSON: key figures, breakdowns, months.

    Key figures are read under either name they are stored by. Months whose label
    is no date are skipped.
    """
    sections = ["kpis", "compute_kpis", "revenue_by_product", "revenue_by_region", "top_customers", "monthly_trend"]
    schema = ", ".join(f"{s} {_VALUES}" for s in sections)
    parsed = history.select(F.col("id").alias("analysis_id"), F.from_json(raw, schema).alias("_r"))
    figures = F.coalesce("_r.kpis", "_r.compute_kpis")
    none = F.lit(None)

    def figure(name: str, category: str) -> Column:
        value = F.try_variant_get(F.try_element_at(figures, F.lit(name)), "$", "double")
        return F.when(value.isNotNull(), _metric(F.lit(name), value, category, none, none))

    kpi_rows = F.filter(F.array(*[figure(k, c) for k, c in KPI_CATEGORIES.items()]), lambda m: m.isNotNull())
    months = F.filter(
        F.map_entries("_r.monthly_trend"),
        lambda e: parse_date(e["key"]).isNotNull() & F.try_variant_get(e["value"], "$", "double").isNotNull(),
    )
    month_rows = F.transform(
        months,
        lambda e: _metric(
            F.lit("monthly_revenue"), F.try_variant_get(e["value"], "$", "double"), "time_series", F.lit("monthly"), parse_date(e["key"])
        ),
    )
    rows = F.concat(
        kpi_rows,
        _per_label("revenue_by_product", "product"),
        _per_label("revenue_by_region", "region"),
        _per_label("top_customers", "customer"),
        F.coalesce(month_rows, _empty(_METRIC)),
    )
    return parsed.select("analysis_id", F.inline(rows)).withColumn("metric_value", F.col("metric_value").try_cast("decimal(20,2)"))


def _items(value: Column) -> Column:
    """Non-empty texts of a variant list."""
    return F.filter(
        F.transform(F.try_variant_get(value, "$", "array<variant>"), _text), lambda t: t.isNotNull() & (t != "")
    )


def _anomaly_texts_of_object(value: Column) -> Column:
    entries = F.map_entries(F.try_variant_get(value, "$", _VALUES))

    def texts(e: Column) -> Column:
        by_month = F.filter(
            F.map_entries(F.try_variant_get(e["value"], "$", _VALUES)),
            lambda m: F.coalesce(_text(m["value"]), F.lit("")) != "",
        )
        label = e["key"]
        return (
            F.when(
                _is(e["value"], "OBJECT"),
                F.transform(by_month, lambda m: F.concat(label, F.lit(" in "), m["key"], F.lit(": "), _text(m["value"]))),
            )
            .when(_is(e["value"], "ARRAY"), F.transform(_items(e["value"]), lambda t: F.concat(label, F.lit(": "), t)))
            .when((_kind(e["value"]) == "STRING") & (_text(e["value"]) != ""), F.array(F.concat(label, F.lit(": "), _text(e["value"]))))
            .otherwise(_empty("string"))
        )

    return F.flatten(F.transform(entries, texts))


def _anomaly_texts(value: Column) -> Column:
    def of_item(item: Column) -> Column:
        return (
            F.when(_is(item, "OBJECT"), _anomaly_texts_of_object(item))
            .when((_kind(item) == "STRING") & (_text(item) != ""), F.array(_text(item)))
            .otherwise(_empty("string"))
        )

    listed = F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), of_item))
    return F.coalesce(F.when(_is(value, "ARRAY"), listed).otherwise(of_item(value)), _empty("string"))


def extract_insights(
    history: DataFrame, raw: str = "insights_json", fill_defaults: bool = False, summary_chars: int | None = SUMMARY_CHARS
) -> DataFrame:
    """``analysis_id`` and typed insight rows: answer, summary, anomalies, recommendations.

    ``fill_defaults`` supplies the answer and summary texts used when a response
    lacks them; such a summary is the answer's first ``summary_chars`` characters, all with None.
    """
    schema = f"answer string, human_readable_summary string, confidence_score double, anomalies variant, recommended_metrics {_VALUES}"
    parsed = history.select(F.col("id").alias("analysis_id"), F.from_json(raw, schema).alias("_i"))
    answer, summary = F.col("_i.answer"), F.col("_i.human_readable_summary")
    if fill_defaults:
        answer = F.when(answer != "", answer).otherwise(F.lit(DEFAULT_ANSWER))
        summary = F.when(summary != "", summary).otherwise(answer if summary_chars is None else F.left(answer, F.lit(summary_chars)))

    def insight(text: Column, kind: str, given: bool) -> Column:
        usual = F.lit(INSIGHT_CONFIDENCE[kind])
        score = F.coalesce("_i.confidence_score", usual) if given else usual
        return F.struct(text.alias("insight_text"), F.lit(kind).alias("insight_type"), score.alias("confidence_score")).cast(_INSIGHT)

    def advice(e: Column) -> Column:
        title = F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" ")))
        return (
            F.when(_kind(e["value"]) == "STRING", F.array(F.concat(title, F.lit(": "), _text(e["value"]))))
            .when(_is(e["value"], "ARRAY"), F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), _text))
            .otherwise(_empty("string"))
        )

    recommended = F.coalesce(F.flatten(F.transform(F.map_entries("_i.recommended_metrics"), advice)), _empty("string"))
    rows = F.concat(
        F.when(answer.isNotNull(), F.array(insight(answer, "answer", True))).otherwise(_empty(_INSIGHT)),
        F.when(summary.isNotNull(), F.array(insight(summary, "summary", True))).otherwise(_empty(_INSIGHT)),
        F.transform(_anomaly_texts(F.col("_i.anomalies")), lambda t: insight(t, "anomaly", False)),
        F.transform(recommended, lambda t: insight(t, "recommendation", False)),
    )
    return parsed.select("analysis_id", F.inline(rows))


def backfill(existing: DataFrame, extracted: DataFrame, history: DataFrame) -> DataFrame:
    """``existing`` with every row of the processed analyses replaced; running twice changes nothing."""
    # the processed ids are hashed, so the rows to keep stream by unsorted
    processed = history.select(F.col("id").alias("analysis_id")).hint("shuffle_hash")
    kept = existing.join(processed, "analysis_id", "left_anti")
    return kept.unionByName(extracted, allowMissingColumns=True)
