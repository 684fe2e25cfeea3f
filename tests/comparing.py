"""Running a query and its SQL side by side."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str:
    """Empty where both give the same rows, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    want = rows(columns, out.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        return f"{name}: {sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    return ""
