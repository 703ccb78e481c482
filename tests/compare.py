"""Rows of a Spark query against rows of its DuckDB SQL."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def by_name(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def differences(df, sql: str, sf_dir: str) -> str:
    """'' if both have the same columns and rows."""
    got = duck(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} and {sorted(got.columns)}"
    a, b = by_name(df.columns, df.collect()), by_name(got.columns, got.fetchall())
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
