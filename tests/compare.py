"""Run a query on Spark and its reference SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

from catalogue.views import TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(folder, table)}.parquet'")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [_value(v) for v in x]
    return x


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_value(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(df):
    return sorted(df.columns), _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    rel = con.sql(sql)
    return sorted(rel.columns), _sorted(rel.columns, rel.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns {set(sc) ^ set(dc)}"
    if sr == dr:
        return None
    a, b = set(map(repr, sr)), set(map(repr, dr))
    only_s, only_d = sorted(a - b)[:3], sorted(b - a)[:3]
    return f"rows {len(sr)} vs {len(dr)}; {len(a - b)}/{len(b - a)} differ\n spark {only_s}\n duck  {only_d}"
