"""Compares a query with its oracle: columns by name, rows as a bag, floats to nine digits."""

import math
from collections import Counter
from pathlib import Path

import duckdb

from kestrelq.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if equal."""
    got_names, got = bag(df.columns, df.collect())
    rel = con.sql(sql)
    want_names, want = bag(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} {want_names}"
    if got != want:
        return f"rows {sum(got.values())} {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return "" if got else "no rows"
