"""Run registered queries against their SQL counterparts.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(repr(_plain(r[i])) for i in order) for r in rows))


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return normal(names, result.fetchall())


def difference(df, con, sql) -> str | None:
    got_cols, got = spark_rows(df)
    want_cols, want = duck_rows(con, sql)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference\n   spark {a}\n   sql   {b}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from salescope.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:]
    spark, con = local_session(8), duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = difference(query(spark, sf_dir), con, sqls[name])
                rows = ""
            else:
                n = len(query(spark, sf_dir).collect())
                problem, rows = None, f"rows only: {n}"
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:900]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {rows} {problem or ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
