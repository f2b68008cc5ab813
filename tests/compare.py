"""Comparing a query's rows with its SQL check."""

from __future__ import annotations

import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if value is None or isinstance(value, (bool, int, str)):
        return value
    try:
        return round(float(value), 6) + 0.0
    except (TypeError, ValueError):
        return str(value)


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else a short description."""
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    got = table(spark_df.columns, spark_df.collect())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    a, b = set(got[1]), set(want[1])
    return f"rows {len(got[1])} vs {len(want[1])}; only query: {sorted(a - b, key=repr)[:2]}; only sql: {sorted(b - a, key=repr)[:2]}"
