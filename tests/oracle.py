"""Holds a Spark result against DuckDB's."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    kind = type(value).__name__
    if value is None or kind == "NaTType" or value != value:
        return None
    if kind.startswith("bool"):
        return bool(value)
    if kind.startswith(("float", "Decimal")):
        return float(f"{float(value):.9g}")
    if kind.startswith(("int", "uint")):
        return float(f"{float(value):.15g}")
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def same(frame, con, sql: str) -> None:
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    ours = rows(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = rows(columns, found.fetchall())
    assert len(ours) == len(theirs)
    assert [a for a, b in zip(ours, theirs) if a != b][:3] == []
