"""Comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr), names


def oracle_rows(sql: str, folder: Path, names: list[str]):
    con = duckdb.connect()
    for p in folder.iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    have = [c[0] for c in cur.description]
    assert sorted(have) == names
    return sorted((tuple(plain(r[have.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
