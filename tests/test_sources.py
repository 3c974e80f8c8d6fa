import io
import os
import sqlite3
import zipfile

import pandas as pd
import pytest

from salescope.sources import database, files, loader, sqlite, workbooks
from salescope.plans.source_queries import _customer_book


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("name;value\nGrün;1\n\"x;y\";\n".encode("latin-1"))
    got = loader.load(spark, "csv", {"path": str(path), "delimiter": ";", "encoding": "ISO-8859-1"}).collect()
    assert [tuple(r) for r in got] == [("Grün", "1"), ("x;y", None)]
    with pytest.raises(FileNotFoundError):
        loader.load(spark, "csv", str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="unknown source"):
        loader.load(spark, "carrier pigeon", "x")


def test_environment(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,2\n")
    assert loader.load_from_environment(spark, {"DATA_SOURCE_TYPE": "csv", "CSV_PATH": str(path)}).count() == 1
    with pytest.raises(ValueError):
        loader.load_from_environment(spark, {"DATA_SOURCE_TYPE": "database", "DB_CONNECTION": "sqlite:///x"})
    with pytest.raises(ValueError):
        loader.load_from_environment(spark, {"DATA_SOURCE_TYPE": "tape"})


def test_connections():
    url = database.parse_connection("postgresql://u:p%40ss@db:6000/shop?sslmode=require")
    assert (url["host"], url["port"], url["database"], url["password"], url["ssl"]) == ("db", 6000, "shop", "p@ss", True)
    assert database.parse_connection("mysql://u@h/d")["port"] == 3306
    assert database.parse_connection("sqlite:///tmp/x.db")["database"] == "/tmp/x.db"
    pairs = database.parse_connection("DB_TYPE=mysql DB_HOST=h DB_NAME=n DB_USER=u DB_PASSWORD=p")
    assert pairs["port"] == 3306 and pairs["username"] == "u"
    for bad in ("", None, "ftp://x/y", "hello", "DB_HOST=h"):
        with pytest.raises(ValueError):
            database.parse_connection(bad)
    options = database.table_options(url, "t", "s", "id", 1, 100, 4)
    assert options["url"] == "jdbc:postgresql://db:6000/shop?sslmode=require" and options["dbtable"] == "s.t"
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        database.table_options(url, "t", partition_column="id")


@pytest.fixture
def database_file(tmp_path):
    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE empty (a INTEGER)")
        con.execute('CREATE TABLE "odd name" (id INTEGER PRIMARY KEY, price REAL, label TEXT)')
        con.executemany('INSERT INTO "odd name" VALUES (?, ?, ?)', [(i, i / 2, f"n{i}") for i in range(1, 1001)])
        con.execute("INSERT INTO \"odd name\" VALUES (5000, 'text in a number', NULL)")
        con.execute('CREATE VIEW v AS SELECT id FROM "odd name" WHERE id <= 10')
    con.close()
    return path


def test_sqlite(spark, database_file):
    tables = {r.table: (r["rows"], r.columns) for r in sqlite.list_tables(spark, database_file).collect()}
    assert tables == {"empty": (0, 1), "odd name": (1001, 3), "v": (10, 1)}
    df = loader.load(spark, "sqlite", database_file)
    assert df.columns == ["id", "price", "label"] and df.rdd.getNumPartitions() == 8
    assert df.count() == 1001 and df.agg({"id": "sum"}).first()[0] == 505500
    assert df.where("id = 5000").first().price is None
    assert loader.load(spark, "database", {"connection": f"sqlite://{database_file}", "table": "v"}).count() == 10
    before = os.path.getmtime(database_file)
    with pytest.raises(FileNotFoundError):
        sqlite.read_sqlite(spark, database_file + ".none")
    assert not os.path.exists(database_file + ".none") and os.path.getmtime(database_file) == before


def test_workbooks(spark, tmp_path):
    for i in range(3):
        pdf = pd.DataFrame({"chunk": [i], "c_custkey": [i], "c_name": [f"n{i}"], "c_acctbal": [i + 0.5]})
        (tmp_path / f"b{i}.xlsx").write_bytes(_customer_book(pdf)["content"][0])
    df = loader.load(spark, "excel", {"path": str(tmp_path), "sheet_name": "Data"})
    assert sorted(tuple(r)[1:] for r in df.collect()) == [(str(i), f"n{i}", str(i + 0.5)) for i in range(3)]


def test_workbook_cells():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>hello</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
        '<row><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    rows = list(workbooks.sheet_rows(buffer.getvalue()))
    assert rows == [["hello", None, "ab"], ["2024-01-01", "2024-01-01 12:00:00", "true"]]
    with pytest.raises(ValueError):
        list(workbooks.sheet_rows(buffer.getvalue(), "missing"))


def test_log_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00.123456' + make_interval(0,0,0,d) AS ts, d FROM (SELECT explode(sequence(0, 4)) AS d)")
    files.append_jsonl(log, path)
    files.overwrite_days(log.where("d = 2").selectExpr("ts", "d + 100 AS d"), path)
    read = files.read_jsonl(spark, path, "ts timestamp_ntz, d int, log_date date", start="2024-01-03", end="2024-01-04")
    assert sorted(r.d for r in read.collect()) == [3, 102] and read.first().ts.microsecond == 123456
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def test_bulk_load_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.txt").write_text("x")
    assert files.bulk_load(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0
