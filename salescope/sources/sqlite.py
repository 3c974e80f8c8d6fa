"""SQLite files as a Spark data source: read-only, one partition per rowid range.

The file must be visible to the executors under the same path.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_BATCH = 10_000


def _connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _tables(con: sqlite3.Connection) -> list[str]:
    found = con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")
    return [name for (name,) in found]


def _columns(con: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    return [(row[1], row[2]) for row in con.execute(f"PRAGMA table_info({_quoted(table)})")]


def _spark_type(declared: str):
    """Type by SQLite's affinity rules; anything but whole and real numbers is text."""
    declared = declared.upper()
    if "INT" in declared:
        return LongType()
    if any(word in declared for word in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return StringType()


def _value(raw, kind):
    """SQLite columns may hold any type: what does not fit the declared one is null."""
    if raw is None:
        return None
    if isinstance(kind, StringType):
        return raw.decode("utf-8", "replace") if isinstance(raw, bytes) else str(raw)
    try:
        return int(raw) if isinstance(kind, LongType) else float(raw)
    except (TypeError, ValueError):
        return None


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))


class _TableReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, partitions: int):
        self.schema, self.path, self.table, self.count = schema, path, table, partitions

    def partitions(self) -> list[_Range]:
        with closing(_connect(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # views and tables without rowids
                return [_Range(None, None)]
        if low is None or not isinstance(low, int) or self.count <= 1:
            return [_Range(None, None)]
        width = -(-(high - low + 1) // self.count)
        return [_Range(start, min(start + width - 1, high)) for start in range(low, high + 1, width)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        low, high = partition.value
        names = ", ".join(_quoted(f.name) for f in self.schema.fields)
        where = "" if low is None else " WHERE rowid BETWEEN ? AND ?"
        kinds = [f.dataType for f in self.schema.fields]
        with closing(_connect(self.path)) as con:
            cursor = con.execute(f"SELECT {names} FROM {_quoted(self.table)}{where}", () if low is None else (low, high))
            while rows := cursor.fetchmany(_BATCH):
                for row in rows:
                    yield tuple(_value(v, k) for v, k in zip(row, kinds))


class _CatalogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition) -> Iterator[tuple]:
        with closing(_connect(self.path)) as con:
            for name in _tables(con):
                (rows,) = con.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()
                yield name, rows, len(_columns(con, name))


class SqliteSource(DataSource):
    """``format("sqlite_file")`` with options ``path``, ``table``, ``partitions``; no table lists the tables."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> StructType | str:
        table = self.options.get("table")
        if table is None:
            return "table string, rows long, columns int"
        with closing(_connect(self.options["path"])) as con:
            columns = _columns(con, table)
        if not columns:
            raise ValueError(f"no table {table!r}")
        return StructType([StructField(name, _spark_type(kind)) for name, kind in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        path, table = self.options["path"], self.options.get("table")
        if table is None:
            return _CatalogReader(path)
        return _TableReader(schema, path, table, int(self.options.get("partitions", 8)))


def list_tables(spark: SparkSession, path: str) -> DataFrame:
    """``table, rows, columns`` of every table and view in the file."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").option("path", path).load()


def first_non_empty_table(path: str) -> str:
    with closing(_connect(path)) as con:
        for name in _tables(con):
            if con.execute(f"SELECT 1 FROM {_quoted(name)} LIMIT 1").fetchone():
                return name
    raise ValueError(f"no table with rows in {path}")


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, partitions: int = 8) -> DataFrame:
    """A table of the file, by default the first one with rows."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(SqliteSource)
    chosen = table or first_non_empty_table(path)
    return spark.read.format("sqlite_file").options(path=path, table=chosen, partitions=str(partitions)).load()
