"""Comparing a Spark result with that of the SQL over the same tables."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

#: The tables that the tests read.
SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return repr(value)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in df.select(*names).collect())
