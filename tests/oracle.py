"""Run a registered query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from strataflow.plans.adapter import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got_cols == want_cols, (got_cols, want_cols)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, (len(wrong), got_cols, wrong[:3])
    return len(got)
