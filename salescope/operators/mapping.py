"""From any sales-like table to the canonical one.

Column names are decided on the driver from the schema alone; the row work is a
single projection without joins or Python.
"""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from salescope.functions.dates import parse_date
from salescope.functions.fixed_values import FUZZY_CUTOFF, MAX_UNMAPPED_SHARE, RATES_TO_USD, STANDARD_COLUMNS
from salescope.functions.money import bare_money_text, currency_code, money_value, rate_to
from salescope.functions.numbers import to_money


@dataclass(frozen=True)
class MappingConfig:
    """Name variants, target currency and rates. Instances are never changed in place."""

    variants: Mapping[str, Sequence[str]] = field(default_factory=lambda: STANDARD_COLUMNS)
    target_currency: str = "USD"
    rates_to_usd: Mapping[str, float] = field(default_factory=lambda: RATES_TO_USD)
    fuzzy_cutoff: float = FUZZY_CUTOFF
    day_first: bool = False

    def with_variants(self, standard: str, names: Sequence[str]) -> MappingConfig:
        """A config that also recognises ``names``; other configs are not affected."""
        if standard not in self.variants:
            raise KeyError(f"no standard column {standard!r}")
        added = [n.lower().strip() for n in names]
        return replace(self, variants={**self.variants, standard: [*self.variants[standard], *added]})


class ColumnMatch(NamedTuple):
    mapping: dict[str, str]
    unmapped: list[str]
    warnings: list[str]


class MappedSales(NamedTuple):
    sales: DataFrame
    mapping: dict[str, str]
    warnings: list[str]


def match_columns(names: Sequence[str], config: MappingConfig = MappingConfig()) -> ColumnMatch:
    """Assign each input name to the first free standard column it fits.

    Per standard column an exact variant or a close spelling counts, so an
    earlier close match goes before a later exact one.
    """
    mapping: dict[str, str] = {}
    free = list(config.variants)
    for name in names:
        lowered = name.lower().strip()
        fits = (
            s
            for s in free
            if lowered in config.variants[s]
            or difflib.get_close_matches(lowered, config.variants[s], n=1, cutoff=config.fuzzy_cutoff)
        )
        standard = next(fits, None)
        if standard:
            mapping[name] = standard
            free.remove(standard)
    unmapped = [n for n in names if n not in mapping]
    warnings = [f"{len(unmapped)} column(s) not recognised and dropped: {', '.join(unmapped)}"] if unmapped else []
    if not mapping:
        warnings.append("no column could be mapped to the standard schema")
    return ColumnMatch(mapping, unmapped, warnings)


def schema_is_acceptable(match: ColumnMatch) -> tuple[bool, str]:
    """Revenue and date must be mapped, and at most 30 % of the columns may be unknown.

    The share is taken over columns, not over warning texts.
    """
    missing = [c for c in ("revenue", "date") if c not in match.mapping.values()]
    if missing:
        return False, f"missing essential column(s): {', '.join(missing)}"
    columns = len(match.mapping) + len(match.unmapped)
    if len(match.unmapped) > columns * MAX_UNMAPPED_SHARE:
        return False, "more than 30% of the columns could not be mapped"
    return True, "schema acceptable"


def rename_to_standard(df: DataFrame, config: MappingConfig = MappingConfig()) -> DataFrame:
    """Mapped columns under their standard names; the rest never leaves the scan."""
    mapping = match_columns(df.columns, config).mapping
    return df.select(*[F.col(f"`{source}`").alias(standard) for source, standard in mapping.items()])


def add_missing_columns(df: DataFrame, config: MappingConfig = MappingConfig()) -> DataFrame:
    """All standard columns in canonical order; absent ones null, currency the target."""
    absent = {"currency": F.lit(config.target_currency)}
    return df.select(
        *[
            F.col(c) if c in df.columns else absent.get(c, F.lit(None).cast("string")).alias(c)
            for c in config.variants
        ]
    )


def with_profit(df: DataFrame) -> DataFrame:
    """Profit from revenue and cost where both are present, replacing any given profit."""
    return df.withColumn("profit", (F.col("revenue") - F.col("cost")).cast("decimal(18,2)"))


def _with_amounts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``_<name>_amount`` as double for each money column, numeric or text."""
    texts = [n for n in names if not isinstance(df.schema[n].dataType, NumericType)]
    staged = df.withColumns({f"_{n}_text": bare_money_text(F.col(n)) for n in texts}) if texts else df
    amounts = {
        f"_{n}_amount": money_value(F.col(f"_{n}_text")) if n in texts else F.col(n).cast("double") for n in names
    }
    return staged.withColumns(amounts).drop(*[f"_{n}_text" for n in texts])


def convert_money(df: DataFrame, config: MappingConfig = MappingConfig()) -> DataFrame:
    """Currency codes, revenue and cost in the target currency, profit and lineage columns.

    Amounts are floored to cents after conversion. A target other than USD uses
    the cross rate, not the rate to USD.
    """
    code = currency_code(F.col("currency"), config.target_currency)
    rate = rate_to(F.col("currency"), config.target_currency, config.rates_to_usd)
    money = ("revenue", "cost")
    coded = _with_amounts(df, money).withColumn("currency", code)
    lineage, converted = {}, {}
    for name in money:
        amount = F.col(f"_{name}_amount")
        lineage[f"{name}_original"] = F.col(name).cast("string")
        lineage[f"{name}_original_currency"] = F.col("currency")
        converted[name] = to_money(F.when(F.col("currency") == config.target_currency, amount).otherwise(amount * rate))
    lineage["monetary_values_in_usd"] = F.lit(config.target_currency == "USD")
    return with_profit(coded.withColumns(lineage).withColumns(converted).drop(*[f"_{n}_amount" for n in money]))


def coerce_types(df: DataFrame, day_first: bool = False) -> DataFrame:
    """Every standard column in its canonical type; what does not parse becomes null. Profit follows from the result."""
    changes = {}
    for name in set(df.columns) & {"date"}:
        kind = df.schema[name].dataType
        as_is = isinstance(kind, (DateType, TimestampType, TimestampNTZType))
        changes[name] = F.col(name).cast("date") if as_is else parse_date(F.col(name).cast("string"), day_first)
    for name in set(df.columns) & {"revenue", "cost"}:
        if isinstance(df.schema[name].dataType, StringType):
            changes[name] = F.col(name).try_cast("double")
    if "quantity" in df.columns:
        changes["quantity"] = F.col("quantity").try_cast("double")
    for name in set(df.columns) & {"customer", "product", "region", "currency", "payment_status"}:
        changes[name] = F.col(name).cast("string")
    typed = df.withColumns(changes)
    # Typing only rounds the representation; flooring to cents belongs to conversion.
    for name in set(df.columns) & {"revenue", "cost"}:
        typed = typed.withColumn(name, F.col(name).try_cast("decimal(18,2)"))
    return with_profit(typed) if {"revenue", "cost"} <= set(df.columns) else typed


def map_schema(df: DataFrame, config: MappingConfig = MappingConfig()) -> MappedSales:
    """Rename, complete, convert and type a sales-like table."""
    match = match_columns(df.columns, config)
    named = add_missing_columns(rename_to_standard(df, config), config)
    return MappedSales(coerce_types(convert_money(named, config), config.day_first), match.mapping, match.warnings)


def conversion_summary(mapped: DataFrame, target: str = "USD") -> DataFrame:
    """Rows, converted cells and unparsable cells per currency, with all currencies first.

    Revenue and cost cells both count.
    """
    cells = ("revenue", "cost")
    foreign = F.col("currency") != target

    def per_cell(test):
        return sum(F.count_if(test(c)) for c in cells)

    return (
        mapped.rollup("currency")
        .agg(
            F.count("*").alias("total_rows"),
            per_cell(lambda c: foreign & F.col(c).isNotNull()).alias("cells_converted"),
            per_cell(lambda c: F.col(f"{c}_original").isNotNull() & F.col(c).isNull()).alias("cells_unparsable"),
            F.grouping("currency").alias("_all"),
        )
        .select(
            F.when(F.col("_all") == 1, "all").otherwise(F.col("currency")).alias("currency"),
            "total_rows",
            "cells_converted",
            "cells_unparsable",
        )
    )


def unparsable_values(mapped: DataFrame) -> DataFrame:
    """The money cells that could not be read: column and original text."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"{c}_original").alias("value"), F.col(c).isNull().alias("lost"))
            for c in ("revenue", "cost")
        ]
    )
    return (
        mapped.select(F.explode(cells).alias("cell"))
        .where(F.col("cell.value").isNotNull() & F.col("cell.lost"))
        .select("cell.column", "cell.value")
    )
