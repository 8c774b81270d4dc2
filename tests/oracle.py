"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from costbook.plans.registry import REGISTRY, oracle
from costbook.sources.bindings import BASE_TABLES, Tables


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("float", "nan")
        return ("float", repr(value + 0.0))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return ("timestamp", value.isoformat())
    return (type(value).__name__, str(value))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rows_of_spark(spark, folder: str, name: str):
    frame = REGISTRY[name].run(Tables(spark, folder))
    order = sorted(frame.columns)
    return order, frame.dtypes, [tuple(r[c] for c in order) for r in frame.collect()]


def rows_of_sql(con, name: str):
    cursor = con.execute(oracle(name))
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, [tuple(r[i] for i in at) for r in cursor.fetchall()]


def difference(spark, con, folder: str, name: str) -> str | None:
    """None when rows, names and types agree, else a short account."""
    got_names, dtypes, got = rows_of_spark(spark, folder, name)
    want_names, want = rows_of_sql(con, name)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if not got:
        return "no rows"
    left = Counter(tuple(map(_cell, r)) for r in got)
    right = Counter(tuple(map(_cell, r)) for r in want)
    if left != right:
        only_left = list((left - right).items())[:3]
        only_right = list((right - left).items())[:3]
        strip = lambda rs: [tuple(c[1] if c[0] != "float" else c for c in r) for r, _ in rs]
        return (f"{got_names}: {len(got)} rows against {len(want)}; off by "
                f"{sum((left - right).values())}\n   spark {strip(only_left)}\n   sql   {strip(only_right)}")
    return None
