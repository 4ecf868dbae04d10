"""Run named queries on both engines and compare every value."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

from quayside.plans.inputs import GIVEN

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return f"dec {v.normalize()}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, sf_dir, name, fn, sql) -> str:
    """An empty text when both engines agree, else what differs."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return f"plan has a {bad}"
    if sql is None:
        return ""
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    names, a = _rows(df.columns, [tuple(r) for r in got])
    other, b = _rows(want_names, want)
    if names != other:
        return f"columns {names} <> {other}"
    types = {
        c: (t, want_types[c]) for c, t in df.dtypes if TYPES.get(t) != want_types[c]
    }
    if types:
        return f"types {types}"
    if a != b:
        only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
        return f"{len(a)} rows <> {len(b)} rows; spark {only_a[:2]} duck {only_b[:2]}"
    if not a:
        return "no rows on either side"
    print(f"  ok {name} rows={len(a)} {spent:.2f}s", flush=True)
    return ""
