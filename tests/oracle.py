"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import datetime as dt
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(float(value) + 0.0))
    if isinstance(value, dt.datetime):
        return (3, value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return (3, dt.datetime(value.year, value.month, value.day).isoformat())
    if type(value).__name__ == "Decimal":
        return (2, repr(float(value)))
    return (4, str(value))


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> dict:
    started = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(canon(row[c]) for c in names) for row in df.collect())
    out = {"rows": len(mine), "sec": round(time.time() - started, 2), "ok": True, "note": ""}
    if sql is None:
        return out
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return out | {"ok": False, "note": f"columns {names} vs {sorted(theirs_names)}"}
    order = [theirs_names.index(c) for c in names]
    theirs = sorted(tuple(canon(row[i]) for i in order) for row in cur.fetchall())
    if len(mine) != len(theirs):
        return out | {"ok": False, "note": f"rows {len(mine)} vs {len(theirs)}"}
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        a, b = bad[0]
        diff = [(n, x[1], y[1]) for n, x, y in zip(names, a, b) if x != y]
        return out | {"ok": False, "note": f"{len(bad)} rows differ, e.g. {diff[:4]}"}
    return out
