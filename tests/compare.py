"""Runs a query and its SQL on the same tables and compares rows without order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        at = f"{folder}/{t}.parquet"
        if os.path.exists(at):
            db.sql(f"create view {t} as select * from read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def differ(df, db, sql: str) -> str:
    """Nothing, or what differs."""
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    want = db.sql(sql)
    need, own = rows(want.columns, want.fetchall())
    if names != own:
        return f"columns {names} and {own}"
    if got != need:
        a, b = [x for x in got if x not in need][:2] if len(got) < 3000 else got[:2], [x for x in need if x not in got][:2] if len(need) < 3000 else need[:2]
        return f"{len(got)} and {len(need)} rows; only here {a}, only there {b}"
    return ""
