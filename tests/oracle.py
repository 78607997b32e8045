"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(folder: Path = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, (bool, int)):
        return v
    return str(v)


def compare(spark, name: str, query, sql: str, folder: Path = DATA) -> None:
    df = query(spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    with connect(folder) as c:
        names = ", ".join(f'"{x}"' for x in columns)
        want = Counter(tuple(plain(x) for x in r) for r in c.execute(f"SELECT {names} FROM ({sql})").fetchall())
    assert got == want, (name, list((got - want).items())[:3], list((want - got).items())[:3])
