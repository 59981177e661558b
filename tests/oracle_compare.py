"""Compare a registered query with its DuckDB statement on one data directory."""
from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """First disagreement between a DataFrame and a statement; None when equal."""
    cursor = con.execute(sql)
    sql_columns = [c[0] for c in cursor.description]
    if sorted(sql_columns) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(sql_columns)}"
    want = _rows(sql_columns, cursor.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        extra = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"rows differ: {len(got)} / {len(want)}; only here {extra[0]}; only there {extra[1]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(df.columns)}\n{a}\n{b}"
    return None
