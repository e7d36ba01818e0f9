"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)) or type(v).__name__ in ("Row", "ndarray"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, int):
        return int(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty where both agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    if not got:
        return "no rows"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ; {names}: {bad[0][0]} and {bad[0][1]}" if bad else ""
