"""Analysis history: one parent table and its metrics, insights and charts.

``history``: id, user_id, analysis_type, question, created_at, status, data_source
``metrics``: metric_id, analysis_id, metric_type, metric_value, metric_date, category, category_name
``insights``: analysis_id, insight_type, insight_text, confidence_score
``charts``: analysis_id, chart_type, chart_path, chart_data
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.lookups import single_value
from salescope.functions.numbers import half_even

CHART_URL = "/api/v1/analysis/chart/"


def _of_user(history: DataFrame, user_id: int | None) -> DataFrame:
    return history if user_id is None else history.where(F.col("user_id") == user_id)


def _of_known(rows: DataFrame, owners: DataFrame, all_users: bool) -> DataFrame:
    """The rows of ``owners`` (column ``analysis_id``).

    Over all analyses the ids are hashed, not sorted: a task then holds its part of the ids and streams the
    wide rows, however many there are. A user's own ids are few, and Spark may send them to all tasks.
    """
    return rows.join(owners.hint("shuffle_hash") if all_users else owners, "analysis_id", "left_semi")


def history_page(
    history: DataFrame,
    metrics: DataFrame,
    insights: DataFrame,
    user_id: int | None = None,
    limit: int = 10,
    offset: int = 0,
) -> DataFrame:
    """One page, newest first, with headline metrics, insight counts and the total.

    The page is cut first; only its rows meet the child tables.
    """
    owned = _of_user(history, user_id)
    total = single_value(owned, F.count("*"))
    page = owned.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)

    def first_of(kind: str) -> Column:
        mine = F.col("metric_type") == kind
        return F.min_by(F.when(mine, F.col("metric_value")), F.when(mine, F.struct("metric_id", "metric_value"))).cast("double")

    headlines = (
        metrics.where(F.col("metric_type").isin("total_revenue", "profit_margin"))
        .join(page.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")
        .groupBy("analysis_id")
        .agg(first_of("total_revenue").alias("total_revenue"), first_of("profit_margin").alias("profit_margin"))
    )
    counts = (
        insights.join(page.select(F.col("id").alias("analysis_id")), "analysis_id", "left_semi")
        .groupBy("analysis_id")
        .agg(F.count("*").alias("insight_count"))
    )
    return (
        page.withColumnRenamed("id", "analysis_id")
        .join(headlines, "analysis_id", "left")
        .join(counts, "analysis_id", "left")
        .select(
            "analysis_id", "analysis_type", "question", "created_at", "data_source", "total_revenue", "profit_margin",
            F.coalesce("insight_count", F.lit(0)).alias("insight_count"), total.alias("total"),
        )
        .orderBy(F.desc("created_at"), F.desc("analysis_id"))
    )


def analysis_detail(
    history: DataFrame, metrics: DataFrame, insights: DataFrame, charts: DataFrame,
    analysis_id: int | None = None, user_id: int | None = None,
) -> DataFrame:
    """Everything known about one or all analyses, in long form.

    ``section`` is metrics, insights or charts and ``grp`` the metric category,
    insight type or chart type. Rows are not folded into arrays, so an analysis
    with very many metrics stays spread over tasks.
    """
    chosen = _of_user(history, user_id)
    if analysis_id is not None:
        chosen = chosen.where(F.col("id") == analysis_id)
    owners = chosen.select(F.col("id").alias("analysis_id"))
    empty = F.lit(None).cast("string")
    parts = [
        metrics.select(
            "analysis_id", F.lit("metrics").alias("section"), F.coalesce("category", F.lit("general")).alias("grp"),
            F.concat_ws("/", "metric_type", "category_name").alias("label"), F.col("metric_value").cast("double").alias("value"),
            F.col("metric_date").cast("string").alias("text"),
        ),
        insights.select(
            "analysis_id", F.lit("insights").alias("section"), F.col("insight_type").alias("grp"), empty.alias("label"),
            F.col("confidence_score").cast("double").alias("value"), F.col("insight_text").alias("text"),
        ),
        charts.select(
            "analysis_id", F.lit("charts").alias("section"), F.col("chart_type").alias("grp"), F.col("chart_path").alias("label"),
            F.lit(None).cast("double").alias("value"), F.col("chart_data").alias("text"),
        ),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if analysis_id is not None:
        rows = rows.where(F.col("analysis_id") == analysis_id)
    return _of_known(rows, owners, user_id is None and analysis_id is None)


def owned_metrics(
    metrics: DataFrame, history: DataFrame, user_id: int | None = None, analysis_id: int | None = None,
    metric_type: str | None = None, category: str | None = None,
) -> DataFrame:
    """Metrics of existing (and the user's own) analyses, by type and category."""
    for column, value in (("analysis_id", analysis_id), ("metric_type", metric_type), ("category", category)):
        if value is not None:
            metrics = metrics.where(F.col(column) == value)
    owners = _of_user(history, user_id).select(F.col("id").alias("analysis_id"))
    return _of_known(metrics, owners, user_id is None and analysis_id is None)


def owned_insights(
    insights: DataFrame, history: DataFrame, user_id: int | None = None, analysis_id: int | None = None,
    insight_type: str | None = None,
) -> DataFrame:
    for column, value in (("analysis_id", analysis_id), ("insight_type", insight_type)):
        if value is not None:
            insights = insights.where(F.col(column) == value)
    owners = _of_user(history, user_id).select(F.col("id").alias("analysis_id"))
    return _of_known(insights, owners, user_id is None and analysis_id is None)


def charts_with_links(charts: DataFrame, history: DataFrame, user_id: int | None = None) -> DataFrame:
    """Charts with their file name and link."""
    owners = _of_user(history, user_id).select(F.col("id").alias("analysis_id"))
    name = F.element_at(F.split("chart_path", "/"), -1)
    return (
        _of_known(charts, owners, user_id is None)
        .withColumn("file_name", name)
        .withColumn("url", F.concat(F.lit(CHART_URL), F.col("file_name")))
    )


def without_analyses(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Each table without the analyses listed in ``doomed.analysis_id``; the parent's key is ``id``."""
    keys = doomed.select("analysis_id")
    return {
        name: df.join(keys.withColumnRenamed("analysis_id", "id") if name == "history" else keys,
                      "id" if name == "history" else "analysis_id", "left_anti")
        for name, df in tables.items()
    }


def metric_by_day(
    metrics: DataFrame, history: DataFrame, metric_type: str = "total_revenue", as_of: str | None = None,
    days: int = 30, user_id: int | None = None,
) -> DataFrame:
    """Daily mean of a metric over the analyses of the ``days`` days up to ``as_of``.

    A metric without its own date counts on the day of its analysis.
    """
    recent = _of_user(history, user_id)
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp_ntz")
        recent = recent.where((F.col("created_at") >= now - F.expr(f"interval {int(days)} days")) & (F.col("created_at") <= now))
    joined = metrics.where(F.col("metric_type") == metric_type).join(
        recent.select(F.col("id").alias("analysis_id"), "created_at"), "analysis_id"
    )
    day = F.coalesce("metric_date", F.col("created_at").cast("date"))
    value = F.col("metric_value").cast("decimal(20,2)")
    return joined.groupBy(day.alias("day")).agg(
        F.round(F.sum(value).cast("double") / F.count(value), 6).alias("value")
    )


def metric_trend(by_day: DataFrame) -> DataFrame:
    """Direction and percent change from the first to the last day.

    Both are null under two days or when the first value is not positive.
    """
    first, last = F.min_by("value", "day"), F.max_by("value", "day")
    usable = (F.count("*") >= 2) & (first > 0)
    return by_day.agg(
        F.count("*").alias("days"),
        F.when(usable, F.when(last > first, "up").otherwise("down")).alias("direction"),
        F.when(usable, half_even((last - first) / F.when(first > 0, first) * 100, 1)).alias("percent_change"),
    )
