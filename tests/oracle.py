"""Rows of a query and of its SQL in comparable form."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = DATA):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        c.sql(f"create view {name.split('.')[0]} as select * from '{path}'")
    return c


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    try:
        return f"{float(v):.9g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in found)
