"""Compares a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(v):
    if v is None:
        return "\0"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        f = float(v)
        return "\0" if math.isnan(f) else f"{round(f, 6):.6g}" if abs(f) < 1e6 else f"{f:.4f}"
    return str(v)


def differences(df, sql, con):
    """Messages; empty when columns and rows agree."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if names != sorted(rel.columns):
        return [f"columns {names} and {sorted(rel.columns)}"]
    mine = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    places = [rel.columns.index(n) for n in names]
    theirs = sorted(tuple(_plain(row[i]) for i in places) for row in rel.fetchall())
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows"]
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return [f"{len(bad)} of {len(mine)} rows differ: {bad[0]}"] if bad else []
