"""CSV, JSON-lines and parquet files, previews and bulk loads."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from salescope.operators.reports import json_rows

_BAD = "_bad_line"
# JSON keeps microseconds only when told to.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "UTF-8",
    schema: str | StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A headed CSV file or folder, all text unless a schema is given.

    No inference pass over the data. ``multi_line`` accepts line breaks inside
    quotes at the price of unsplittable files.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def _with_bad_line(schema: str | StructType) -> StructType:
    fields = StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    return StructType([*fields, StructField(_BAD, StringType())])


def read_jsonl(
    spark: SparkSession, path: str, schema: str | StructType, start: str | None = None, end: str | None = None
) -> DataFrame:
    """JSON lines; inclusive day bounds prune ``log_date`` folders.

    Only lines that are no JSON object are skipped. A field of another type than the schema's is
    null, and its row stays with its other fields.
    """
    rows = spark.read.schema(_with_bad_line(schema)).options(columnNameOfCorruptRecord=_BAD, **JSON_TIMES).json(path)
    for bound, keep in ((start, lambda d: F.col("log_date") >= d), (end, lambda d: F.col("log_date") <= d)):
        if bound is not None:
            rows = rows.where(keep(F.to_date(F.lit(bound))))
    # Spark also sets the bad line for valid JSON with a mistyped field.
    is_object = F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(_BAD))), F.lit("")), F.lit("OBJECT"))
    return rows.where(F.col(_BAD).isNull() | is_object).drop(_BAD)


def append_jsonl(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows as JSON lines in one folder per day."""
    # rebalanced, so that a day gets as many files as its size asks for, not one from every task
    df.withColumn("log_date", F.col(ts).cast("date")).hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").options(**JSON_TIMES).json(path)


def overwrite_days(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Replace only the days that ``df`` holds."""
    dated = df.withColumn("log_date", F.col(ts).cast("date")).hint("rebalance", "log_date")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").options(**JSON_TIMES).json(path)


def export_json(stats: DataFrame, path: str) -> str:
    """Write a statistics table as JSON and return its path."""
    stats.write.mode("overwrite").json(path)
    return path


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows in key order as JSON-safe text."""
    return json_rows(df.orderBy(key).limit(n))


def write_sales(sales: DataFrame, path: str) -> None:
    """Store the canonical table by month, so that date filters read only their months."""
    dated = sales.withColumn("month", F.trunc("date", "MM")).hint("rebalance", "month")
    dated.write.mode("overwrite").partitionBy("month").parquet(path)


def bulk_load(
    spark: SparkSession, folder: str, target: str, names: Mapping[str, str] | None = None, delimiter: str = ","
) -> DataFrame:
    """Replace one parquet table per CSV file (or folder) in ``folder``: ``table, rows, columns``.

    Tables take the file's name without extension, ``-`` as ``_``, unless ``names``
    gives another. Two files with the same table name are an error, raised before anything is
    written. Only the file listing reaches the driver.
    """
    pattern = f"{folder.rstrip('/')}/*"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(pattern)
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    inside = F.substring_index(F.col("path"), root + "/", -1)
    first = F.split(inside, "/")[0]
    loaded, tables = [], {}
    for row in listed.select(first.alias("name")).distinct().orderBy("name").collect():
        stem = os.path.splitext(row.name)[0].replace("-", "_")
        table = (names or {}).get(row.name, stem)
        if table in tables:
            raise ValueError(f"{tables[table]} and {row.name} would both load into {table}; name one of them")
        tables[table] = row.name
    for table, name in tables.items():
        data = read_csv(spark, f"{folder.rstrip('/')}/{name}", delimiter)
        where = f"{target.rstrip('/')}/{table}"
        data.write.mode("overwrite").parquet(where)
        written = spark.read.parquet(where)
        loaded.append(
            written.agg(F.lit(table).alias("table"), F.count("*").alias("rows"), F.lit(len(data.columns)).alias("columns"))
        )
    if not loaded:
        return spark.createDataFrame([], "table string, rows long, columns int")
    return reduce(DataFrame.unionByName, loaded)
