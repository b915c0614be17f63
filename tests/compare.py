"""Runs registered queries in Spark and their oracles in DuckDB and compares them."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, run, sql, folder, tolerance=0.0):
    """None when equal, else a short text on the first difference."""
    df = run(spark, folder)
    left_cols, left = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    right_cols, right = normal(cur.fetchall(), [d[0] for d in cur.description])
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        for x, y, c in zip(a, b, left_cols):
            same = x == y and type(x) is type(y)
            if not same and isinstance(x, float) and isinstance(y, float):
                same = abs(x - y) <= tolerance * max(1.0, abs(x))
            if not same:
                return f"{c}: {x!r} != {y!r} in {a} / {b}"[:600]
    return None if left else "empty"
