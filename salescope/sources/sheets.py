"""Spreadsheet cells as columns: padding, blanks, numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_number(cell: Column) -> Column:
    """The number in a cell, dollar signs and commas dropped; null when it is not one."""
    bare = F.trim(F.regexp_replace(cell, "[$,]", ""))
    digits = F.regexp_replace(bare, "[.-]", "").rlike("^[0-9]+$")
    return F.when(digits, bare.try_cast("double"))


def cell_text(cell: Column) -> Column:
    """Text of a cell, empty as null."""
    return F.nullif(cell, F.lit(""))


def clean_rows(rows: DataFrame, values: str, headers: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Named columns from rows of cells in array column ``values``.

    Short rows are padded with nulls. ``numeric`` columns become doubles; cells
    of theirs that hold no number become null.
    """

    def column(i: int, name: str) -> Column:
        cell = F.get(F.col(values), F.lit(i))
        return (cell_number(cell) if name in numeric else cell_text(cell)).alias(name)

    kept = [F.col(c) for c in rows.columns if c != values]
    return rows.select(*kept, *[column(i, name) for i, name in enumerate(headers)])
