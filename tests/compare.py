"""Rows of a DataFrame and of a DuckDB relation in one canonical form."""

from __future__ import annotations

import datetime
import glob
import os
from decimal import Decimal


def _value(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, Decimal)):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return "[" + ",".join(map(_value, x)) + "]"
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{_value(v)}" for k, v in x.items()) + "}"
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    return str(x)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_value(r[i]) for i in order) for r in rows)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con
