"""Model call records: ``model, ts, call_id, latency_ms, input_tokens, output_tokens, success``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.functions.fixed_values import DEFAULT_PRICED_MODEL, FLAT_TOKEN_PRICES
from salescope.functions.ranking import latest_per_key


def call_stats(calls: DataFrame, prices: Mapping[str, float] = FLAT_TOKEN_PRICES) -> DataFrame:
    """Calls, success rate, latency over successes, tokens and estimated cost per model."""
    table = F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p))])
    price = F.coalesce(F.try_element_at(table, F.col("model")), F.lit(float(prices[DEFAULT_PRICED_MODEL])))
    latency = F.when(F.col("success"), F.col("latency_ms"))
    summed = calls.groupBy("model").agg(
        F.count("*").alias("total_calls"),
        F.count_if("success").alias("successful_calls"),
        F.count_if(~F.col("success")).alias("failed_calls"),
        F.coalesce(F.round(F.avg(latency), 6), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.min(latency), F.lit(0.0)).alias("min_latency_ms"),
        F.coalesce(F.max(latency), F.lit(0.0)).alias("max_latency_ms"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
    )
    tokens = F.col("total_input_tokens") + F.col("total_output_tokens")
    return summed.withColumns(
        {
            "success_rate": F.round(F.col("successful_calls") / F.col("total_calls"), 6),
            "estimated_cost": F.round(tokens / 1000 * price, 4),
        }
    )


def keep_latest_per_model(calls: DataFrame, n: int) -> DataFrame:
    return latest_per_key(calls, ["model"], [F.desc("ts"), F.desc("call_id")], n)


def keep_latest(calls: DataFrame, n: int) -> DataFrame:
    return calls.orderBy(F.desc("ts"), F.desc("call_id")).limit(n)
