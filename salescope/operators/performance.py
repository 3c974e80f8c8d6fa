"""Statistics over operation logs: ``operation, ts, event_id, duration, is_error``.

An error row counts as a failed call; its duration is not part of the timings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.functions.fixed_values import HIGH_ERROR_RATE, SLOW_SECONDS
from salescope.functions.lookups import join_same
from salescope.functions.numbers import half_even
from salescope.functions.ranking import index_percentiles, time_ordered_index

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
RANKINGS = ("avg", "p95", "error_rate", "count")


def operation_stats(log: DataFrame, exact: bool = True) -> DataFrame:
    """Count, mean, extremes, percentiles, deviation and error rate per operation.

    ``exact=False`` takes percentiles from a mergeable sketch in the same pass.
    """
    timed = F.when(~F.col("is_error"), F.col("duration"))
    errors = F.count_if("is_error")
    calls = F.count(timed)
    figures = [
        calls.alias("count"),
        half_even(F.avg(timed), 4).alias("avg"),
        half_even(F.min(timed), 4).alias("min"),
        half_even(F.max(timed), 4).alias("max"),
        half_even(F.stddev_pop(timed), 4).alias("std_dev"),
        half_even(errors / F.count("*"), 4).alias("error_rate"),
        errors.alias("errors"),
    ]
    if exact:
        base = log.groupBy("operation").agg(*figures)
        ranks = index_percentiles(log.where(~F.col("is_error")), ["operation"], "duration", PERCENTILES)
        stats = join_same(base, ranks, ["operation"], "left")
    else:
        sketch = F.approx_percentile(timed, list(PERCENTILES.values()), 10_000)
        stats = log.groupBy("operation").agg(*figures, sketch.alias("_p"))
        stats = stats.withColumns({name: F.get("_p", F.lit(i)) for i, name in enumerate(PERCENTILES)})
    shown = ["avg", "min", "max", "p50", "p95", "p99", "std_dev"]
    return stats.select(
        "operation", "count", *[F.coalesce(half_even(F.col(c), 4), F.lit(0.0)).alias(c) for c in shown], "error_rate", "errors"
    )


def operation_summary(stats: DataFrame) -> DataFrame:
    """Totals over all operations, the slowest and the most error-prone.

    Errors are summed directly, so operations that only ever failed count too.
    """
    return stats.agg(
        F.sum("count").alias("total_operations"),
        F.sum("errors").alias("total_errors"),
        half_even(F.sum("errors") / F.greatest(F.sum(F.col("count") + F.col("errors")), F.lit(1)), 4).alias("overall_error_rate"),
        F.count("*").alias("active_operations"),
        F.min_by("operation", F.struct(-F.col("avg"), "operation")).alias("slowest_operation"),
        F.max("avg").alias("slowest_avg"),
        F.min_by("operation", F.struct(-F.col("error_rate"), "operation")).alias("most_error_prone"),
        F.max("error_rate").alias("highest_error_rate"),
    )


def operation_ranking(stats: DataFrame, by: str = "avg", n: int = 10) -> DataFrame:
    """Top operations by a figure; an unknown figure means the mean."""
    by = by if by in RANKINGS else "avg"
    return stats.orderBy(F.desc(by), "operation").limit(n)


def slow_operations(stats: DataFrame, seconds: float = SLOW_SECONDS) -> DataFrame:
    slow = stats.where((F.col("avg") > seconds) & (F.col("count") > 0))
    return slow.select("operation", "avg").orderBy(F.desc("avg"), "operation")


def high_error_operations(stats: DataFrame, rate: float = HIGH_ERROR_RATE) -> DataFrame:
    failing = stats.where((F.col("error_rate") > rate) & (F.col("count") > 0))
    return failing.select("operation", "error_rate").orderBy(F.desc("error_rate"), "operation")


def duration_series(log: DataFrame, operation: str | None = None) -> DataFrame:
    """Durations in time order with their 0-based index, for one or every operation."""
    timed = log.where(~F.col("is_error"))
    if operation is not None:
        timed = timed.where(F.col("operation") == operation)
    rows = timed.select("operation", "ts", "event_id", "duration")
    return time_ordered_index(rows, ["operation"], "ts", "event_id").select("operation", "index", "duration")
