"""Rows of a Spark query against the rows of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def check(df, sf_dir: str, sql: str) -> None:
    names, want = oracle(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want)
    missing, extra = want - got, got - want
    assert not missing and not extra, f"{sum(missing.values())} rows missing, {sum(extra.values())} extra of {sum(want.values())}: {list(missing.items())[:2]} {list(extra.items())[:2]}"
