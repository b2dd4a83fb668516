"""Runs queries and their SQL over the same tables and compares them, rows in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for n in TABLES:
        if Path(f"{sf_dir}/{n}.parquet").exists():
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    if hasattr(v, "item"):
        return v.item()
    return v


def compare(df, con, sql):
    """None if they agree, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    if want == got:
        return None
    a, b = set(map(repr, want)), set(map(repr, got))
    return f"{len(want)} and {len(got)} rows; only SQL: {[x[:300] for x in list(a - b)[:2]]}; only Spark: {[x[:300] for x in list(b - a)[:2]]}"
