"""Compare a Spark result with DuckDB's, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> int:
    got = df.collect()
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rows(rel.columns, rel.fetchall())
    have = rows(df.columns, got)
    assert have == want, f"only Spark: {list((have - want).items())[:3]}; only DuckDB: {list((want - have).items())[:3]}"
    return len(got)
