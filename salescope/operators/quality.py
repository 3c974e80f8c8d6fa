"""Checks on an incoming table: schema gate and one-pass row profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from salescope.functions.dates import parse_date
from salescope.functions.fixed_values import MAX_COLUMNS, MAX_TEXT_LENGTH, MIN_ROWS
from salescope.functions.numbers import half_even

REQUIRED = ("date", "revenue")


def find_columns(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Standard name to actual name, ignoring case everywhere."""
    actual = {c.lower(): c for c in reversed(df.columns)}
    return {n: actual[n.lower()] for n in names if n.lower() in actual}


def check_schema(df: DataFrame, required: Sequence[str] = REQUIRED, max_columns: int = MAX_COLUMNS) -> dict[str, str]:
    """Raise unless the required columns exist and the table is not too wide."""
    found = find_columns(df, required)
    missing = [n for n in required if n not in found]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    if len(df.columns) > max_columns:
        raise ValueError(f"{len(df.columns)} columns; at most {max_columns} are allowed")
    return found


def quality_report(
    df: DataFrame,
    min_rows: int = MIN_ROWS,
    max_rows: int | None = None,
    max_text: int = MAX_TEXT_LENGTH,
    day_first: bool = False,
) -> DataFrame:
    """One row per check: ``check, column, value, passed``. The table is scanned once.

    A null date or revenue counts as invalid. ``max_rows`` is off by default.
    """
    found = check_schema(df)
    date, revenue = F.col(f"`{found['date']}`"), F.col(f"`{found['revenue']}`")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    customer = find_columns(df, ["customer"]).get("customer")

    typed = isinstance(df.schema[found["date"]].dataType, (DateType, TimestampType, TimestampNTZType))
    parsed = date if typed else parse_date(date.cast("string"), day_first)
    aggregates = [
        F.count("*").alias("rows"),
        F.count_if(parsed.isNull()).alias("bad_dates"),
        F.count_if(revenue.cast("string").try_cast("double").isNull()).alias("bad_numbers"),
        *[F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)).cast("long").alias(f"len_{i}") for i, c in enumerate(texts)],
    ]
    if customer:
        aggregates.append(F.count_if(F.col(f"`{customer}`").isNull()).alias("no_customer"))

    def check(name: str, column: str | None, value, passed):
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(column).cast("string").alias("column"),
            value.cast("double").alias("value"),
            passed.alias("passed"),
        )

    rows = F.col("rows")
    enough = (rows >= min_rows) & (rows <= max_rows if max_rows is not None else F.lit(True))
    checks = [
        check("row_count", None, rows, enough),
        check("invalid_dates", found["date"], F.col("bad_dates"), F.col("bad_dates") == 0),
        check("non_numeric", found["revenue"], F.col("bad_numbers"), F.col("bad_numbers") == 0),
        *[
            check("max_text_length", c, F.col(f"len_{i}"), F.col(f"len_{i}") <= max_text)
            for i, c in enumerate(texts)
        ],
    ]
    if customer:
        share = F.when(rows > 0, half_even(F.col("no_customer") * 100 / rows, 1)).otherwise(F.lit(0.0))
        checks += [
            check("missing_customers", customer, F.col("no_customer"), F.lit(True)),
            check("missing_customers_pct", customer, share, F.lit(True)),
        ]
    return df.agg(*aggregates).select(F.inline(F.array(*checks)))
