"""Workbooks (.xlsx) read in parallel, one file per task row.

Cells come as text: numbers as written, date-formatted cells in ISO form. The
older binary .xls format is not read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from salescope.session import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheet_file(book: zipfile.ZipFile, sheet: int | str) -> str:
    sheets = _xml(book, "xl/workbook.xml").find(f"{_MAIN}sheets")
    chosen = sheets[sheet] if isinstance(sheet, int) else next((s for s in sheets if s.get("name") == sheet), None)
    if chosen is None:
        raise ValueError(f"no sheet {sheet!r}")
    links = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    target = links[chosen.get(_LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    styles = _xml(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {
        int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt")
        if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())
    }
    formats = styles.find(f"{_MAIN}cellXfs")
    dates = _DATE_FORMATS | custom
    return {i for i, xf in enumerate(formats if formats is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _position(reference: str) -> int:
    column = 0
    for letter in re.match("[A-Z]+", reference).group():
        column = column * 26 + ord(letter) - 64
    return column - 1


def _cell(cell, shared: list[str], dates: set[int]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if cell.get("t") == "s":
        return shared[int(value.text)]
    if cell.get("t") == "b":
        return "true" if value.text == "1" else "false"
    if cell.get("t") is None and int(cell.get("s", 0)) in dates:
        moment = datetime(1899, 12, 30) + timedelta(days=float(value.text))
        return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(sep=" ", timespec="seconds")
    return value.text


def sheet_rows(content: bytes, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """Rows of one sheet as lists of text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _xml(book, "xl/sharedStrings.xml")
        shared = [] if strings is None else ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in strings]
        dates = _date_styles(book)
        with book.open(_sheet_file(book, sheet)) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in row:
                    at = _position(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _cell(cell, shared, dates)
                yield cells
                row.clear()


def parse_workbooks(books: DataFrame, columns: list[str], sheet: int | str = 0, header: int = 0) -> DataFrame:
    """Rows of many workbooks (``path, content``) under the given column names.

    Columns are found by each file's own header row; a file lacking one gives nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = sheet_rows(content, sheet)
                names: list[str | None] = []
                for _ in range(header + 1):
                    names = next(rows, [])
                places = [names.index(c) if c in names else None for c in columns]
                picked = [[r[p] if p is not None and p < len(r) else None for p in places] for r in rows]
                yield pd.DataFrame(picked, columns=columns, dtype=object).assign(path=path)[["path", *columns]]

    ship(books.sparkSession)
    schema = ", ".join(["path string", *[f"`{c}` string" for c in columns]])
    return books.select("path", "content").mapInPandas(run, schema)


def header_names(books: DataFrame, sheet: int | str = 0, header: int = 0) -> DataFrame:
    """(place, name) of every header cell, and one row without a name for every workbook."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[int, str | None]] = []
            for content in batch["content"]:
                rows = sheet_rows(content, sheet)
                names: list[str | None] = []
                for _ in range(header + 1):
                    names = next(rows, [])
                found += [(-1, None), *((n, c) for n, c in enumerate(names) if c)]
            yield pd.DataFrame(found, columns=["place", "name"])

    ship(books.sparkSession)
    return books.select("content").mapInPandas(run, "place int, name string")


def read_workbooks(
    spark: SparkSession, path: str, sheet: int | str = 0, header: int = 0, columns: list[str] | None = None
) -> DataFrame:
    """Workbooks below ``path``."""
    return workbook_table(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), sheet, header, columns)


def workbook_table(books: DataFrame, sheet: int | str = 0, header: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Rows of the given workbooks (``path, content``); without ``columns`` all headers together name them.

    The headers are read by the workers; only the distinct names come to the driver, ordered by
    their first place in a sheet and then by name.
    """
    if columns is None:
        named = header_names(books, sheet, header).groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()
        columns = [r.name for r in named if r.name is not None]
        if not named:
            raise FileNotFoundError("no workbook to read")
    return parse_workbooks(books, columns, sheet, header)
