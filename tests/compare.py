"""Compare a Spark result with DuckDB's, value by value and without regard to row order."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb

TABLES = ("orders", "nation", "region")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Number of Spark rows, and what differs."""
    names, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other_names, theirs = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != other_names:
        return len(mine), [f"columns {sorted(set(names) ^ set(other_names))}"]
    if len(mine) != len(theirs):
        return len(mine), [f"{len(mine)} rows against {len(theirs)}"]
    out = []
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            bad = [f"{n}: {x!r} / {y!r}" for n, x, y in zip(names, a, b, strict=True) if x != y]
            out.append("; ".join(bad))
    return len(mine), out
