"""Failure logs: ``failure_id, ts, error_type, tool, message, available_columns, object_type``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.dates import micros
from salescope.functions.fixed_values import (
    AUTO_APPLY_CONFIDENCE,
    AUTO_APPLY_COUNT,
    DATE_ERROR_WORDS,
    FIX_TEXTS,
    MIN_SIMILAR_FAILURES,
    NONE_ERROR_WORDS,
    NUMBER_ERROR_WORDS,
    SHOWN_COLUMNS,
    SIMILAR_HOURS,
    SIMILAR_MESSAGE_CHARS,
)
from salescope.functions.lookups import join_same
from salescope.functions.numbers import half_even, ratio
from salescope.functions.text import contains_any

# Error types with advice; keys with a comma are variants of these.
FIXABLE_ERRORS = [kind for kind in FIX_TEXTS if "," not in kind]
_KIND = ["error_type", "tool", "_message"]


def similar_failures(
    failures: DataFrame, hours: int = SIMILAR_HOURS, bucket_seconds: int = 60, message_chars: int | None = SIMILAR_MESSAGE_CHARS
) -> DataFrame:
    """Per failure, how many alike (itself included) happened in the ``hours`` up to it.

    Alike means same type, tool and first ``message_chars`` characters of the message,
    or the whole message with None. Counting
    is exact but not a window over all rows of one kind, which a frequent failure
    would turn into a single task: instants are counted first, whole buckets come
    from a running sum of bucket counts, and only the rows of one bucket are ever
    ordered together.
    """
    bucket, span = bucket_seconds * 1_000_000, hours * 3600 * 1_000_000
    if span % bucket:
        raise ValueError("the bucket must divide the window")
    message = F.coalesce("message", F.lit(""))
    marked = failures.withColumns(
        {
            "_message": message if message_chars is None else F.left(message, F.lit(message_chars)),
            "_at": micros(F.col("ts")),
        }
    )
    instants = marked.groupBy(*_KIND, "_at").agg(F.count("*").alias("_n"))

    def placed(shift: int, rows: Column, order: int) -> DataFrame:
        at = F.col("_at") - shift
        return instants.select(
            *_KIND, "_at", at.alias("_place"), F.floor(at / bucket).cast("long").alias("_bucket"), rows.alias("_rows"), F.lit(order).alias("_probe"),
        )

    # A probe sits at the far edge of its failure's window, just before the rows of that instant.
    mixed = placed(0, F.col("_n"), 1).unionByName(placed(span, F.lit(0).cast("long"), 0))
    upto = Window.partitionBy(*_KIND, "_bucket").orderBy("_place", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        mixed.withColumn("_upto", F.sum("_rows").over(upto))
        .groupBy(*_KIND, "_at")
        .agg(F.sum(F.when(F.col("_probe") == 1, F.col("_upto")).otherwise(-F.col("_upto"))).alias("_edge"))
        .withColumn("_bucket", F.floor(F.col("_at") / bucket).cast("long"))
    )
    whole = Window.partitionBy(*_KIND).orderBy("_bucket").rangeBetween(-span // bucket, -1)
    buckets = (
        instants.groupBy(*_KIND, F.floor(F.col("_at") / bucket).cast("long").alias("_bucket"))
        .agg(F.sum("_n").alias("_n"))
        .select(*_KIND, "_bucket", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_whole"))
    )
    counts = join_same(edges, buckets, [*_KIND, "_bucket"]).select(
        *_KIND, "_at", (F.col("_edge") + F.col("_whole")).alias("similar_count")
    )
    return join_same(marked, counts, [*_KIND, "_at"]).select(*failures.columns, "similar_count")


def fix_success_rates(fixes: DataFrame) -> DataFrame:
    """Share of successful fixes per error type, from ``error_type, success`` rows."""
    return fixes.groupBy("error_type").agg(
        F.count("*").alias("fixes"), F.avg(F.col("success").cast("int")).alias("success_rate")
    )


def suggestion(
    error_type: Column, message: Column, columns: Column, object_type: Column, shown_columns: int | None = SHOWN_COLUMNS
) -> Column:
    """What to do about a failure; null for types nothing is known about.

    Message tests ignore case throughout. Of the available columns ``shown_columns`` are named, all with None.
    """
    lower = F.lower(message)
    named = F.when(F.contains(message, F.lit("'")), F.regexp_extract(message, "'([^']*)", 1)).otherwise("unknown")
    shown = F.array_join(columns if shown_columns is None else F.slice(columns, 1, shown_columns), ", ")
    cut = F.lit(False) if shown_columns is None else F.size(columns) > shown_columns

    def text(key: str, *parts: Column) -> Column:
        return F.format_string(FIX_TEXTS[key], *parts) if parts else F.lit(FIX_TEXTS[key])

    variants = {
        "KeyError": F.when(cut, text("KeyError, more columns", named, shown))
        .when(F.size(columns) > 0, text("KeyError, up to 10 columns", named, shown))
        .otherwise(text("KeyError", named)),
        "ValueError": F.when(contains_any(lower, DATE_ERROR_WORDS), text("ValueError, date"))
        .when(contains_any(lower, NUMBER_ERROR_WORDS), text("ValueError, number"))
        .otherwise(text("ValueError")),
        "TypeError": F.when(contains_any(lower, NONE_ERROR_WORDS), text("TypeError, none")).otherwise(text("TypeError")),
        "AttributeError": F.when(object_type.isNotNull(), text("AttributeError, known type", named, object_type)).otherwise(
            text("AttributeError", named)
        ),
        "ImportError": text("ImportError", named, named),
    }
    return F.coalesce(*[F.when(error_type == kind, variants.get(kind, text(kind))) for kind in FIXABLE_ERRORS])


def with_suggestions(failures: DataFrame, shown_columns: int | None = SHOWN_COLUMNS) -> DataFrame:
    parts = [F.col(c) for c in ("error_type", "message", "available_columns", "object_type")]
    return failures.withColumn("suggestion", suggestion(*parts, shown_columns))


def fix_actions(failures: DataFrame, fixes: DataFrame) -> DataFrame:
    """Failures repeated often enough, with suggestion, confidence and whether to apply it unasked."""
    n = F.col("similar_count")
    repeated = similar_failures(failures).where((n >= MIN_SIMILAR_FAILURES) & F.col("error_type").isin(FIXABLE_ERRORS))
    rated = repeated.join(fix_success_rates(fixes).select("error_type", "success_rate"), "error_type", "left")
    base = F.least(0.3 + (n - MIN_SIMILAR_FAILURES) * 0.1, F.lit(0.9))
    confidence = half_even(F.least(base + F.coalesce("success_rate", F.lit(0.0)) * 0.15, F.lit(0.95)), 2)
    return (
        with_suggestions(rated)
        .withColumn("confidence", confidence)
        .withColumn("auto_apply", (F.col("confidence") >= AUTO_APPLY_CONFIDENCE) & (n > AUTO_APPLY_COUNT))
        .select("failure_id", "error_type", "tool", "similar_count", "suggestion", "confidence", "auto_apply")
    )


def action_report(actions: DataFrame) -> DataFrame:
    """Totals over ``auto_apply, fixed`` rows."""
    fixed, auto = F.count_if("fixed"), F.count_if("auto_apply")
    return actions.agg(
        F.count("*").alias("total_actions"),
        auto.alias("auto_applied"),
        (F.count("*") - auto).alias("manual_applied"),
        fixed.alias("resolved"),
        ratio(fixed, F.count("*"), 0.0).alias("success_rate"),
    )


def recent_failures(failures: DataFrame, n: int = 10) -> DataFrame:
    return failures.orderBy(F.desc("ts"), F.desc("failure_id")).limit(n)


def common_errors(failures: DataFrame, n: int = 10) -> DataFrame:
    counted = failures.groupBy("error_type").agg(F.count("*").alias("failures"))
    return counted.orderBy(F.desc("failures"), "error_type").limit(n)


def _cutoff(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")


def keep_recent(failures: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; rows without a time cannot be told to be old and stay."""
    return failures.where(F.col("ts").isNull() | (F.col("ts") >= _cutoff(as_of, days)))


def retention_counts(failures: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows that ``keep_recent`` removes and keeps, and how many of the kept have no time."""
    old = F.coalesce(F.col("ts") < _cutoff(as_of, days), F.lit(False))
    return failures.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"), F.count_if(F.col("ts").isNull()).alias("undated"))
