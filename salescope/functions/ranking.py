"""Exact ranks and percentiles that do not put one hot key into one task.

A plain ``row_number`` over a key sorts that key's rows in a single task. The
helpers here first collapse equal values, then rank coarse buckets, and sort
rows only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.dates import micros
from salescope.functions.lookups import join_same

# Buckets per e-fold of the value; a bucket spans about 0.4 % of the value.
_BINS_PER_FOLD = 256
# ln of the smallest and largest doubles lies within +-746.
_BIN_SHIFT = 746 * _BINS_PER_FOLD


def ordered_bin(value: Column) -> Column:
    """A bucket number that never decreases as the value grows; NaN counts as largest."""
    size = F.floor(F.ln(F.abs(value)) * _BINS_PER_FOLD) + _BIN_SHIFT
    beyond = F.lit(3 * _BIN_SHIFT)
    return (
        F.when(F.isnan(value) | (value == float("inf")), beyond)
        .when(value == float("-inf"), -beyond)
        .when(value > 0, size)
        .when(value < 0, -size)
        .otherwise(F.lit(0))
        .cast("long")
    )


def index_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]
) -> DataFrame:
    """``sorted(values)[min(int(n * p), n - 1)]`` per key, one column per fraction.

    Null values are left out. Equal values are counted before the first shuffle
    and only the buckets holding a wanted rank are sorted.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_bin", ordered_bin(F.col("_value")))
    )
    by_bin = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_key = Window.partitionBy(*keys)
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.least(
                    F.floor(F.col("_total").cast("double") * F.lit(p)).cast("long"), F.col("_total") - 1
                ).alias("rank"),
            )
            for name, p in fractions.items()
        ]
    )
    targets = (
        counted.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_rows"))
        .select(
            *keys,
            "_bin",
            "_rows",
            F.coalesce(F.sum("_rows").over(by_bin), F.lit(0)).alias("_before"),
            F.sum("_rows").over(per_key).alias("_total"),
        )
        .select(*keys, "_bin", "_rows", "_before", F.explode(wanted).alias("_want"))
        .where((F.col("_want.rank") >= F.col("_before")) & (F.col("_want.rank") < F.col("_before") + F.col("_rows")))
        .select(*keys, "_bin", F.col("_want.name").alias("_name"), (F.col("_want.rank") - F.col("_before")).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_bin", "_name").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_same(counted, targets, [*keys, "_bin"])
        .withColumn("_upto", F.sum("_n").over(inside))
        .where((F.col("_upto") > F.col("_offset")) & (F.col("_upto") - F.col("_n") <= F.col("_offset")))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in fractions])
    )


def time_ordered_index(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str = "index", bucket_seconds: int = 60
) -> DataFrame:
    """0-based position of each row per key in (``ts``, ``tie``) order.

    ``tie`` is a unique integer. Positions come from counts of earlier time
    buckets, then of earlier instants in the bucket, then a sort of the rows of
    one instant in chunks of the tie column.
    """
    keys = list(keys)
    step = bucket_seconds * 1_000_000
    placed = df.withColumns(
        {
            "_bucket": F.floor(micros(F.col(ts)) / step).cast("long"),
            "_chunk": F.floor(F.col(tie) / (1 << 20)).cast("long"),
        }
    )
    fine = [*keys, "_bucket", ts, "_chunk"]
    counted = placed.groupBy(*fine).agg(F.count("*").alias("_n"))
    earlier = (Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(ts, "_chunk").rowsBetween(*earlier)
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*earlier)
    buckets = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(over_buckets), F.lit(0)).alias("_base"))
    )
    offsets = (
        counted.withColumn("_inner", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
        .transform(lambda df: join_same(df, buckets, [*keys, "_bucket"]))
        .select(*fine, (F.col("_inner") + F.col("_base")).alias("_offset"))
    )
    rows = Window.partitionBy(*fine).orderBy(tie)
    return (
        join_same(placed, offsets, fine)
        .withColumn(out, F.col("_offset") + F.row_number().over(rows) - 1)
        .select(*df.columns, out)
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: int = 32
) -> DataFrame:
    """Top ``n`` rows per key: first within salted parts of the key, then overall.

    No task sees more than one part of a hot key in the first step, nor more
    than ``spread * n`` of its rows in the second.
    """
    columns = df.columns
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(spread)))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .where(F.col("_rank") <= n)
        .select(*columns)
    )
