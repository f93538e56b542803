"""Side-by-side comparison of a query's rows and those of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb
import numpy as np


def plain(x):
    if x is None or (isinstance(x, float) and x != x) or type(x).__name__ in ("NaTType", "NAType"):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, (dt.datetime, dt.date)):
        return str(x).removesuffix(" 00:00:00").split("+")[0]
    return str(x) if not isinstance(x, str) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])


def duck_rows(sql: str, data: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    return rows_of(names, got.fetchall())
