"""Token costs of model calls: ``ts, model, input_tokens, output_tokens, agent, user, session_id``."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.functions.fixed_values import DEFAULT_PRICED_MODEL, TOKEN_PRICES
from salescope.functions.lookups import day_spine
from salescope.functions.text import estimated_tokens

Prices = Mapping[str, tuple[float, float]]


def _price(model: Column, prices: Prices, side: int) -> Column:
    """Price of one token as an exact decimal."""

    def exact(pair: tuple[float, float]) -> Column:
        return F.lit(Decimal(str(pair[side])) / 1000).cast("decimal(18,12)")

    table = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), exact(p))])
    return F.coalesce(F.try_element_at(table, model), exact(prices[DEFAULT_PRICED_MODEL]))


def call_costs(calls: DataFrame, prices: Prices = TOKEN_PRICES) -> DataFrame:
    """Input, output and total cost per call; unknown models take the default price.

    Costs are exact decimals, so rounding and totals do not depend on row order.
    """
    parts = {
        f"{side}_cost": F.col(f"{side}_tokens").cast("decimal(19,0)") * _price(F.col("model"), prices, i)
        for i, side in enumerate(("input", "output"))
    }
    exact = calls.withColumns(parts).withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))
    return exact.withColumns({c: F.round(c, 6).cast("decimal(18,6)") for c in ("input_cost", "output_cost", "total_cost")})


def with_estimated_tokens(texts: DataFrame, prompt: str, answer: str) -> DataFrame:
    """Token counts from text length, four characters to a token."""
    return texts.withColumns(
        {"input_tokens": estimated_tokens(F.col(prompt)), "output_tokens": estimated_tokens(F.col(answer))}
    )


def _rounded(total: Column) -> Column:
    return F.round(total, 4).cast("double")


def cost_totals(costs: DataFrame) -> DataFrame:
    """Calls, tokens and cost by session, agent, user and model in one pass: ``level, name``."""
    levels = ["session_id", "agent", "user", "model"]
    grouped = costs.groupingSets([[c] for c in levels], *levels)
    level = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, c) for c in levels])
    name = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in levels])
    return grouped.agg(
        F.count("*").alias("calls"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        _rounded(F.sum("total_cost")).alias("cost"),
        *[F.grouping(c).alias(f"_g_{c}") for c in levels],
    ).select(level.alias("level"), name.alias("name"), "calls", "tokens", "cost")


def daily_costs(costs: DataFrame) -> DataFrame:
    return costs.groupBy(F.col("ts").cast("date").alias("day")).agg(
        _rounded(F.sum("total_cost")).alias("cost"), F.count("*").alias("calls")
    )


def _within(costs: DataFrame, as_of: str, days: int) -> DataFrame:
    last = F.to_date(F.lit(as_of))
    start = F.date_sub(last, days - 1).cast("timestamp_ntz")
    return costs.where((F.col("ts") >= start) & (F.col("ts") < F.date_add(last, 1).cast("timestamp_ntz")))


def daily_cost_report(costs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Cost and calls for each of the last ``days`` days; quiet days are 0."""
    spine = day_spine(costs.sparkSession, as_of, days)
    return (
        spine.join(daily_costs(_within(costs, as_of, days)), "day", "left")
        .select("day", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("calls", F.lit(0)).alias("calls"))
        .orderBy("day")
    )


def cost_report(costs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The period's totals by agent, user and model, and overall: ``section, name, calls, cost``."""
    recent = _within(costs, as_of, days)
    levels = ["agent", "user", "model"]
    grouped = recent.groupingSets([[], *[[c] for c in levels]], *levels)
    section = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, c) for c in levels], F.lit("total"))
    name = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in levels], F.lit("total"))
    return grouped.agg(
        F.count("*").alias("calls"),
        F.coalesce(_rounded(F.sum("total_cost")), F.lit(0.0)).alias("cost"),
        *[F.grouping(c).alias(f"_g_{c}") for c in levels],
    ).select(section.alias("section"), name.alias("name"), "calls", "cost")


def top_by_cost(costs: DataFrame, who: str, n: int = 5) -> DataFrame:
    return (
        costs.groupBy(who)
        .agg(F.sum("total_cost").alias("_cost"))
        .orderBy(F.desc("_cost"), who)
        .limit(n)
        .select(who, _rounded(F.col("_cost")).alias("cost"))
    )
