"""Loading by source type."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from salescope.sources import database, files, sqlite, workbooks

Config = Mapping[str, Any] | str


def _options(config: Config, key: str = "path") -> dict[str, Any]:
    return {key: config} if isinstance(config, str) else dict(config)


def _csv(spark: SparkSession, config: Config) -> DataFrame:
    return files.read_csv(spark, **_options(config))


def _excel(spark: SparkSession, config: Config) -> DataFrame:
    options = _options(config)
    options["sheet"] = options.pop("sheet_name", options.pop("sheet", 0))
    return workbooks.read_workbooks(spark, **options)


def _sqlite(spark: SparkSession, config: Config) -> DataFrame:
    return sqlite.read_sqlite(spark, **_options(config))


def _parquet(spark: SparkSession, config: Config) -> DataFrame:
    return spark.read.parquet(_options(config)["path"])


def _jsonl(spark: SparkSession, config: Config) -> DataFrame:
    return files.read_jsonl(spark, **_options(config))


def _query(spark: SparkSession, config: Config) -> DataFrame:
    options = _options(config, "sql")
    return database.run_query(spark, options["sql"], options.get("params"))


def _database(spark: SparkSession, config: Config) -> DataFrame:
    options = _options(config, "connection")
    connection = options.pop("connection")
    if isinstance(connection, str):
        connection = database.parse_connection(connection)
    if connection["type"] == "sqlite":
        return sqlite.read_sqlite(spark, connection["database"], options.get("table"))
    if "query" in options:
        return database.read_query(spark, connection, options["query"])
    return database.read_table(spark, connection, options.pop("table"), **options)


SOURCES: dict[str, Callable[[SparkSession, Config], DataFrame]] = {
    "csv": _csv,
    "excel": _excel,
    "sqlite": _sqlite,
    "parquet": _parquet,
    "jsonl": _jsonl,
    "query": _query,
    "database": _database,
}


def load(spark: SparkSession, source_type: str, config: Config) -> DataFrame:
    """Read from a named kind of source; a plain string is its path, query or connection."""
    if source_type not in SOURCES:
        raise ValueError(f"unknown source type {source_type!r}; known are {', '.join(SOURCES)}")
    return SOURCES[source_type](spark, config)


def load_from_environment(spark: SparkSession, environ: Mapping[str, str] | None = None) -> DataFrame:
    """Read what ``DATA_SOURCE_TYPE`` and the variables of that type name."""
    env = os.environ if environ is None else environ
    kind = env.get("DATA_SOURCE_TYPE", "csv").lower()
    if kind == "csv":
        return load(spark, "csv", {"path": env["CSV_PATH"], "delimiter": env.get("CSV_DELIMITER", ",")})
    if kind == "excel":
        sheet = env.get("EXCEL_SHEET", "0")
        return load(spark, "excel", {"path": env["EXCEL_PATH"], "sheet": int(sheet) if sheet.isdigit() else sheet})
    if kind != "database":
        raise ValueError(f"unknown DATA_SOURCE_TYPE {kind!r}")
    config = {"connection": env["DB_CONNECTION"]}
    if env.get("DB_QUERY"):
        config["query"] = env["DB_QUERY"]
    elif env.get("DB_TABLE"):
        config["table"] = env["DB_TABLE"]
    else:
        raise ValueError("DB_QUERY or DB_TABLE must be set")
    return load(spark, "database", config)
