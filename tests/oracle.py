"""Run a registered query and its SQL oracle and compare them."""

from __future__ import annotations

import glob
import os

import duckdb

TYPES = {
    "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(df, con, sql: str):
    """None when equal, otherwise a text that says what differs."""
    rel = con.sql(sql)
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if got_types != want_types:
        diff = {k: (got_types.get(k), want_types.get(k)) for k in set(got_types) | set(want_types)
                if got_types.get(k) != want_types.get(k)}
        return f"schema (spark, sql): {diff}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return None if want else "EMPTY"
    cols = sorted(df.columns)
    text = f"rows spark={len(got)} sql={len(want)}"
    bad = 0
    shown = []
    for g, w in zip(got, want):
        if g != w:
            bad += 1
            if len(shown) < 3:
                shown.append([(c, a, b) for c, a, b in zip(cols, g, w) if a != b][:4] + [("key", *g[:3])])
    return text + f" differing={bad} {shown}"
