"""Rows of a Spark query and of its DuckDB SQL on the same tables, in one comparable form."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    """A value without regard to the library it came from; floats to nine significant digits."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v.is_integer() and abs(v) < 2**53 else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return con


def assert_same(spark, query, sql: str, sf_dir: str = DATA) -> None:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = connect(sf_dir).execute(sql)
    other = rows_of([c[0] for c in got.description], got.fetchall())
    assert mine[0] == other[0], (mine[0], other[0])
    extra = [r for r in mine[1] if r not in set(other[1])][:3]
    missing = [r for r in other[1] if r not in set(mine[1])][:3]
    assert mine[1] == other[1], f"{len(mine[1])} rows, SQL has {len(other[1])}; only here {extra}; only in SQL {missing}"
