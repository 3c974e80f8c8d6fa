"""Continuous forms of the log aggregates, and log ingest.

Each job takes a streaming frame and returns one; :func:`run_available` drives it
over everything present and hands back the written table. Windows close when the
watermark passes their end, so state stays bounded by the watermark delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salescope.functions.fixed_values import MIN_SIMILAR_FAILURES, SIMILAR_MESSAGE_CHARS, SLOW_SECONDS
from salescope.functions.lookups import single_value
from salescope.operators.audit import redact_json
from salescope.operators.costs import call_costs
from salescope.session import scratch_path
from salescope.sources.files import JSON_TIMES


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def _watermarked(df: DataFrame, delay: str) -> DataFrame:
    """Event time as an instant (zone-less times count as UTC), with a watermark."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _ends(running: bool) -> list[Column]:
    return [F.max("ts").alias("last_event")] if running else []


def _end_columns(running: bool) -> list[Column]:
    return [F.col("window.end").alias("window_end"), F.col("last_event")] if running else []


def daily_costs(calls: DataFrame, delay: str = "1 hour", running: bool = False) -> DataFrame:
    """Cost and calls per day, agent, user and model. Calls later than the delay are dropped.

    In append mode days appear once they are closed; with ``running`` the job is meant
    for :func:`run_windows`, which shows open days as well.
    """
    return (
        _watermarked(call_costs(calls), delay).groupBy(F.window("ts", "1 day"), "agent", "user", "model")
        .agg(F.count("*").alias("calls"), F.sum("total_cost").alias("cost"), *_ends(running))
        .select(F.col("window.start").cast("date").alias("day"), "agent", "user", "model", "calls", "cost", *_end_columns(running))
    )


def operation_windows(log: DataFrame, width: str = "1 hour", delay: str = "1 hour", running: bool = False) -> DataFrame:
    """Operation statistics per tumbling window, percentiles from a sketch; ``running`` as in :func:`daily_costs`."""
    timed = F.when(~F.col("is_error"), F.col("duration"))
    return (
        _watermarked(log, delay)
        .groupBy(F.window("ts", width), "operation")
        .agg(
            F.count(timed).alias("count"),
            F.round(F.avg(timed), 6).alias("avg"),
            F.max(timed).alias("max"),
            F.approx_percentile(timed, 0.95, 10_000).alias("p95"),
            F.round(F.count_if("is_error") / F.count("*"), 4).alias("error_rate"),
            F.count_if(timed > SLOW_SECONDS).alias("slow_calls"),
            *_ends(running),
        )
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("start"), "operation", "count", "avg", "max", "p95", "error_rate", "slow_calls",
            *_end_columns(running),
        )
    )


def repeated_failures(failures: DataFrame, delay: str = "1 hour", running: bool = False) -> DataFrame:
    """Kinds of failure seen at least three times in a 24-hour window sliding by the hour; ``running`` as in :func:`daily_costs`."""
    kind = F.left("message", F.lit(SIMILAR_MESSAGE_CHARS)).alias("message")
    return (
        _watermarked(failures, delay)
        .groupBy(F.window("ts", "24 hours", "1 hour"), "error_type", "tool", kind)
        .agg(F.count("*").alias("failures"), *_ends(running))
        .where(F.col("failures") >= MIN_SIMILAR_FAILURES)
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "error_type", "tool", "message", "failures", *_end_columns(running))
    )


def ab_rollup(metrics: DataFrame) -> DataFrame:
    """Running count, sum and extremes per test, metric and version, for update mode."""
    return metrics.groupBy("test_name", "metric_name", "version").agg(
        F.count("*").alias("count"),
        F.sum(F.col("metric_value").cast("decimal(18,6)")).alias("total"),
        F.min("metric_value").alias("min"),
        F.max("metric_value").alias("max"),
    )


def redacted_log(log: DataFrame) -> DataFrame:
    """Log entries with sensitive details hidden and their day as partition column."""
    return log.withColumns({"details": redact_json(F.col("details")), "log_date": F.col("ts").cast("date")})


def run_windows(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """All windows of a windowed job, the newest and still open ones too: the newest version of each.

    For jobs whose rows hold ``window_end`` and ``last_event``. A window is ``closed`` once
    the latest event lies at least an hour past its end.
    """
    newest = run_updates(stream, keys, label)
    latest = single_value(newest, F.max("last_event"))
    closed = F.col("window_end") <= latest - F.expr("interval 1 hour")
    return newest.withColumn("closed", closed).drop("window_end", "last_event")


def run_available(stream: DataFrame, label: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> DataFrame:
    """Process everything available in append mode and return the written table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format(fmt)
        .options(**JSON_TIMES)
        .outputMode("append")
        .option("checkpointLocation", f"{path}/_state")
        .partitionBy(*(partition_by or []))
        .trigger(availableNow=True)
        .start(f"{path}/table")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).options(**JSON_TIMES).load(f"{path}/table")


def run_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Process everything available in update mode; the newest version of each key.

    A batch overwrites its own folder, so a batch repeated after a failure does
    not count twice.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", f"{path}/_state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    versions = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return versions.withColumn("_version", F.row_number().over(newest)).where("_version = 1").drop("_version", "batch")
