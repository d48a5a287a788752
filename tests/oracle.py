"""Compares a query with its SQL in DuckDB: names, row counts, values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return round(float(v), 6)
    return v.isoformat(sep=" ") if hasattr(v, "isoformat") else v


def compare(spark, sf_dir: str, run, sql: str) -> None:
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = connect(sf_dir).execute(sql)
    own = [d[0] for d in cur.description]
    assert sorted(own) == names, (sorted(own), names)
    order = [own.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (names, a, b)
