"""Compare a query's rows with those of its SQL check in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from assetloom.plans.tables import BASE


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / (name + '.parquet')}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(df, con, sql: str, show: int = 3) -> str:
    """Empty when equal; otherwise what differs."""
    cur = con.execute(sql)
    theirs_cols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {sorted(df.columns)} vs {sorted(theirs_cols)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(theirs_cols, theirs)
    if a == b:
        return ""
    left, right = set(a) - set(b), set(b) - set(a)
    clip = lambda rows: [tuple(str(v)[:90] for v in r) for r in sorted(rows, key=str)[:show]]
    return f"{len(a)} vs {len(b)} rows; only Spark {len(left)}: {clip(left)}; only SQL {len(right)}: {clip(right)}"
