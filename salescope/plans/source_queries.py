"""Sources and sinks, fed with files that Spark writes from the tables first."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from salescope.operators import performance
from salescope.plans import log_queries as logs
from salescope.plans.tables import over_sales, sales, table
from salescope.session import scratch_path
from salescope.sources import database, files, loader, sheets, workbooks

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _csv_scan(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")).write.option("header", True).option("sep", ";").csv(path)
    read = loader.load(spark, "csv", {"path": path, "delimiter": ";", "encoding": "UTF-8"})
    return read.select(F.col("o_orderkey").cast("long"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date"), F.col("o_totalprice").cast("double"))


_add("csv_scan", _csv_scan, "SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders")
_add(
    "parquet_dispatch",
    lambda s, d: loader.load(s, "parquet", f"{d}/customer.parquet"),
    "SELECT * FROM customer",
)
_add(
    "query_with_parameters",
    lambda s, d: database.run_query(
        s,
        "SELECT o_orderpriority, count(*) AS orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS price FROM {orders} "
        "WHERE o_orderstatus = :status AND o_totalprice >= :least GROUP BY o_orderpriority",
        {"status": "F", "least": 1000.0},
        orders=table(s, d, "orders"),
    ),
    """SELECT o_orderpriority, count(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY 1""",
)
_add(
    "preview_rows",
    lambda s, d: files.preview(table(s, d, "events"), "event_id", 10),
    """
SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id || ',"event_type":"' || event_type
       || '","value":' || value || ',"props":"' || replace(props, '"', '\\"') || '"}' AS json FROM events ORDER BY event_id LIMIT 10""",
)


def _cells(spark, sf_dir):
    """Order rows as spreadsheet cells: money with signs, blanks, and rows of different length."""
    o = table(spark, sf_dir, "orders")
    price = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    full = F.array(F.col("o_orderkey").cast("string"), price, F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority"))
    rows = o.select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, F.slice(full, 1, 2)).otherwise(full).alias("cells"))
    return sheets.clean_rows(rows, "cells", ["order", "price", "status", "priority"], numeric=["order", "price", "priority"])


_add(
    "cleaned_sheet_cells",
    _cells,
    """
SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS "order", round(o_totalprice, 2) AS price,
       CASE WHEN o_custkey % 3 = 0 OR o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS status, CAST(NULL AS DOUBLE) AS priority FROM orders""",
)


def _jsonl_scan(spark, sf_dir):
    """A day-partitioned log with broken lines among the good ones, bounded to two weeks."""
    path = scratch_path(spark, "events-jsonl")
    events = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), good)).otherwise(good)
    events.select(line.alias("value"), F.col("ts").cast("date").alias("log_date")).write.partitionBy("log_date").text(path)
    schema = "event_id long, user_id long, event_type string, value double, log_date date"
    return files.read_jsonl(spark, path, schema, start="2024-01-05", end="2024-01-18")


_add(
    "jsonl_log_scan",
    _jsonl_scan,
    """
SELECT event_id, user_id, event_type, value, ts::DATE AS log_date FROM events
WHERE event_id % 10 <> 3 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-18'""",
)


def _jsonl_mistyped(spark, sf_dir):
    """Lines with a field of another type among good and broken ones."""
    path = scratch_path(spark, "events-mistyped")
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 5
    good = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    worded = F.to_json(F.struct("event_id", "user_id", "event_type", F.lit("high").alias("value")))
    line = F.when(kind == 1, worded).when(kind == 2, F.concat(F.lit("[1, "), good)).when(kind == 3, F.lit('"text"')).otherwise(good)
    e.select(line.alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double")


_add(
    "jsonl_mistyped_fields",
    _jsonl_mistyped,
    "SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 <> 1 THEN value END AS value FROM events WHERE event_id % 5 NOT IN (2, 3)",
)


def _jsonl_append(spark, sf_dir):
    """Two appends to the same day folders, read back."""
    path = scratch_path(spark, "log-append")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    files.append_jsonl(events.where(F.col("event_type") == "error"), path)
    files.append_jsonl(events.where(F.col("event_type") != "error"), path)
    back = files.read_jsonl(spark, path, "event_id long, ts timestamp_ntz, event_type string, value double, log_date date")
    return back.groupBy("log_date", "event_type").agg(F.count("*").alias("rows"), F.max("ts").alias("latest"))


_add(
    "jsonl_append",
    _jsonl_append,
    "SELECT ts::DATE AS log_date, event_type, count(*) AS rows, max(ts) AS latest FROM events GROUP BY 1, 2",
)


def _exported(spark, sf_dir):
    stats = performance.operation_stats(logs.operations(spark, sf_dir))
    path = files.export_json(stats, scratch_path(spark, "metrics-json"))
    return spark.read.schema(stats.schema).json(path)


_add("metrics_export", _exported, logs.OPERATIONS_SQL + "SELECT * FROM stats")


def _bulk(spark, sf_dir):
    folder, target = scratch_path(spark, "csv-folder"), scratch_path(spark, "tables")
    for name in ("customer", "part", "supplier"):
        table(spark, sf_dir, name).write.option("header", True).csv(f"{folder}/{name}-2024.csv")
    return files.bulk_load(spark, folder, target, {"part-2024.csv": "products"})


_add(
    "bulk_load",
    _bulk,
    """
SELECT 'customer_2024' AS "table", count(*) AS rows, CAST(5 AS INTEGER) AS columns FROM customer
UNION ALL SELECT 'products', count(*), 6 FROM part UNION ALL SELECT 'supplier_2024', count(*), 4 FROM supplier""",
)


def _customer_book(pdf: pd.DataFrame) -> pd.DataFrame:
    return _book(pdf, ("Key", "Name", "Balance"))


def _book(pdf: pd.DataFrame, names: tuple[str, ...]) -> pd.DataFrame:
    """A minimal workbook of one chunk of customers."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def text(v):
        return f'<c t="inlineStr"><is><t>{v}</t></is></c>'

    rows = ["<row>" + "".join(map(text, names)) + "</row>"]
    for key, name, balance in zip(pdf["c_custkey"], pdf["c_name"], pdf["c_acctbal"]):
        rows.append(f"<row><c><v>{key}</v></c>{text(name)}<c><v>{balance!r}</v></c></row>")
    files_ = {
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in files_.items():
            book.writestr(name, content)
    return pd.DataFrame({"path": [f"customers-{pdf['chunk'].iloc[0]}.xlsx"], "content": [buffer.getvalue()]})


def _workbook_scan(spark, sf_dir):
    """One workbook per hundred customers, all read by one scan."""
    chunked = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_custkey") / 100).cast("long").alias("chunk"))
    books = chunked.groupBy("chunk").applyInPandas(_customer_book, "path string, content binary")
    rows = workbooks.parse_workbooks(books, ["Key", "Name", "Balance"], sheet="Data")
    return rows.select("path", F.col("Key").cast("long").alias("key"), F.col("Name").alias("name"), F.col("Balance").cast("double").alias("balance"))


_add(
    "workbook_scan",
    _workbook_scan,
    "SELECT 'customers-' || (c_custkey // 100) || '.xlsx' AS path, c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer",
)


def _workbook_headers(spark, sf_dir):
    """Workbooks whose headers differ: every second calls its last column otherwise."""
    chunked = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_custkey") / 100).cast("long").alias("chunk"))

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        return _book(pdf, ("Key", "Name", "Balance" if pdf["chunk"].iloc[0] % 2 else "Credit"))

    books = chunked.groupBy("chunk").applyInPandas(book, "path string, content binary")
    return workbooks.workbook_table(books, sheet="Data").select(
        F.col("Key").cast("long").alias("key"), F.col("Balance").cast("double").alias("balance"), F.col("Credit").cast("double").alias("credit")
    )


_add(
    "workbook_headers_united",
    _workbook_headers,
    "SELECT c_custkey AS key, CASE WHEN (c_custkey // 100) % 2 = 1 THEN c_acctbal END AS balance, CASE WHEN (c_custkey // 100) % 2 = 0 THEN c_acctbal END AS credit FROM customer",
)


def _stored_sales(spark, sf_dir):
    """The canonical table written by month, then read for one year."""
    path = scratch_path(spark, "sales")
    files.write_sales(sales(spark, sf_dir, ["date", "region", "revenue"]), path)
    year = spark.read.parquet(path).where((F.col("month") >= "1997-01-01") & (F.col("month") < "1998-01-01"))
    return year.groupBy("region").agg(F.sum("revenue").cast("double").alias("revenue"), F.count("*").alias("rows"))


_add(
    "stored_sales_by_month",
    _stored_sales,
    over_sales(" SELECT region, CAST(SUM(revenue) AS DOUBLE) AS revenue, count(*) AS rows FROM sales WHERE year(date) = 1997 GROUP BY 1"),
)
