"""Runs queries on Spark and their SQL on DuckDB over the same tables and compares rows."""

from __future__ import annotations

import math
import os

import duckdb

SF = os.environ.get("DOCSIGNAL_SF", "/root/testdata/sf0.001")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def connect(sf_dir: str = SF):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        at = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c
