"""SQL databases over JDBC, and queries on registered tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_PORTS = {"postgresql": 5432, "mysql": 3306}
_DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}


def parse_connection(text: str) -> dict[str, Any]:
    """Connection fields from a URL or from ``DB_HOST=... DB_NAME=...`` pairs.

    Pairs are separated by blanks, semicolons or line ends.
    """
    if not isinstance(text, str) or not text.strip():
        raise ValueError("the connection must be a non-empty string")
    text = text.strip()
    if "://" in text:
        url = urlparse(text)
        if url.scheme == "sqlite":
            return _fields("sqlite", database=url.path)
        if url.scheme not in _PORTS:
            raise ValueError(f"unsupported database: {url.scheme}")
        return _fields(
            url.scheme, url.hostname, url.port or _PORTS[url.scheme], url.path.lstrip("/"),
            url.username, unquote(url.password) if url.password else None, "sslmode=require" in url.query,
        )
    pairs = dict(re.findall(r"(\w+)=([^;\s]+)", text))
    if not pairs.keys() & {"DB_HOST", "DB_TYPE"}:
        raise ValueError("unsupported connection format")
    kind = pairs.get("DB_TYPE", "postgresql").lower()
    needed = ["DB_NAME"] if kind == "sqlite" else ["DB_HOST", "DB_NAME"]
    missing = [n for n in needed if n not in pairs]
    if missing:
        raise ValueError(f"missing {', '.join(missing)} for {kind}")
    if kind == "sqlite":
        return _fields("sqlite", database=pairs["DB_NAME"])
    return _fields(
        kind, pairs["DB_HOST"], int(pairs.get("DB_PORT", _PORTS.get(kind, 3306))), pairs["DB_NAME"],
        pairs.get("DB_USER"), pairs.get("DB_PASSWORD"), pairs.get("DB_SSL", "false").lower() == "true",
    )


def _fields(kind, host=None, port=None, database=None, username=None, password=None, ssl=False) -> dict[str, Any]:
    return {
        "type": kind, "host": host, "port": port, "database": database,
        "username": username, "password": password, "ssl": ssl,
    }


def jdbc_options(connection: Mapping[str, Any]) -> dict[str, str]:
    """Spark JDBC options for a parsed connection."""
    kind = connection["type"]
    if kind not in _DRIVERS:
        raise ValueError(f"no JDBC driver for {kind}")
    url = f"jdbc:{kind}://{connection['host']}:{connection['port']}/{connection['database']}"
    if connection.get("ssl"):
        url += "?sslmode=require" if kind == "postgresql" else "?useSSL=true"
    options = {"url": url, "driver": _DRIVERS[kind], "fetchsize": "10000"}
    if connection.get("username"):
        options["user"] = connection["username"]
    if connection.get("password"):
        options["password"] = connection["password"]
    return options


def table_options(
    connection: Mapping[str, Any],
    table: str,
    schema: str | None = None,
    partition_column: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options for reading a whole table; a partition column spreads it over parallel range reads."""
    options = {**jdbc_options(connection), "dbtable": f"{schema}.{table}" if schema else table}
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, connection: Mapping[str, Any], table: str, **layout) -> DataFrame:
    return spark.read.format("jdbc").options(**table_options(connection, table, **layout)).load()


def read_query(spark: SparkSession, connection: Mapping[str, Any], sql: str) -> DataFrame:
    """A query run by the database itself."""
    return spark.read.format("jdbc").options(**jdbc_options(connection), query=sql).load()


def run_query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """Spark SQL with named parameters over registered tables or the given frames (as ``{name}``)."""
    return spark.sql(sql, args=dict(params or {}), **tables)
