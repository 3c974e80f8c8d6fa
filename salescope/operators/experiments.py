"""A/B tests: assignment, per-version results and the winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.fixed_values import AB_P95_MIN_ROWS
from salescope.functions.lookups import join_same
from salescope.functions.ranking import index_percentiles


def assigned_version(
    user_id: Column, test_name: Column | str, control: str = "v1", treatment: str = "v2", split: float = 0.5
) -> Column:
    """Version by hash: the first 32 bits of md5(``user:test``) as a share below ``split``."""
    name = F.lit(test_name) if isinstance(test_name, str) else test_name
    digest = F.md5(F.concat(user_id.cast("string"), F.lit(":"), name).cast("binary"))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32
    return F.when(share < split, F.lit(treatment)).otherwise(F.lit(control))


def metric_results(metrics: DataFrame, p95_min_rows: int = AB_P95_MIN_ROWS) -> DataFrame:
    """Mean, extremes, count and p95 per test, metric and version.

    The percentile is the value at position int(0.95 n); it is null under ``p95_min_rows`` rows.
    """
    keys = ["test_name", "metric_name", "version"]
    base = metrics.groupBy(*keys).agg(
        F.round(F.avg("metric_value"), 6).alias("avg"),
        F.min("metric_value").alias("min"),
        F.max("metric_value").alias("max"),
        F.count("*").alias("count"),
    )
    ranks = index_percentiles(metrics, keys, "metric_value", {"p95": 0.95})
    return join_same(base, ranks, keys, "left").withColumn("p95", F.when(F.col("count") >= p95_min_rows, F.col("p95")))


def metric_winners(metrics: DataFrame, control: str = "v1", treatment: str = "v2") -> DataFrame:
    """Better version per test and metric: lower latency, else higher; ties keep the control.

    Null when either version has no rows.
    """

    def mean_of(version: str) -> Column:
        return F.round(F.avg(F.when(F.col("version") == version, F.col("metric_value"))), 6)

    pair = metrics.groupBy("test_name", "metric_name").agg(
        mean_of(control).alias("control_avg"), mean_of(treatment).alias("treatment_avg")
    )
    a, b = F.col("control_avg"), F.col("treatment_avg")
    better = F.when(F.col("metric_name") == "latency", b < a).otherwise(b > a)
    return pair.withColumn("winner", F.when(a.isNotNull() & b.isNotNull(), F.when(better, treatment).otherwise(control)))


def version_benchmark(results: DataFrame) -> DataFrame:
    """Average latency per prompt version."""
    return results.groupBy("version").agg(F.round(F.avg("latency"), 6).alias("avg_latency")).orderBy("version")
