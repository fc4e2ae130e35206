"""Compares a query with its SQL the way the driver does: rows as multisets, columns by name."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        q = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM read_parquet('{q}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    return v


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"
    cols = sorted(ours.column_names)
    kinds = [(c, str(ours.schema.field(c).type), str(theirs.schema.field(c).type)) for c in cols]
    loose = {"large_string": "string"}
    bad = [k for k in kinds if loose.get(k[1], k[1]) != loose.get(k[2], k[2]) and not ("list" in k[1] or "struct" in k[1])]
    a = Counter(tuple(_norm(r[c]) for c in cols) for r in ours.to_pylist())
    b = Counter(tuple(_norm(r[c]) for c in cols) for r in theirs.to_pylist())
    if a != b:
        return f"{sum(a.values())} / {sum(b.values())} rows; only ours {list((a - b).items())[:3]}; only theirs {list((b - a).items())[:3]}"
    return f"types {bad}" if bad else ""
