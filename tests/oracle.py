"""Run a query and its SQL over the same tables and compare rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def of_sql(sql: str, d: str):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = c.sql(sql)
    return rows(r.columns, r.fetchall())


_made: dict = {}


def once(spark, query, name: str, d: str):
    """The DataFrame of a query that several tests look at, made once."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _made:
        _made[key] = query(spark, d)
    return _made[key]


def differences(spark, query, sql: str, d: str) -> str:
    """Empty if both agree."""
    df = query(spark, d)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), of_sql(sql, d)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"{a[1].total()} and {b[1].total()} rows; only Spark {list((a[1] - b[1]).items())[:4]}, only SQL {list((b[1] - a[1]).items())[:4]}"
    return ""
