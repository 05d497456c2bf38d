"""Runs a query in Spark and its SQL in DuckDB, and compares them as sorted values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "is_finite"):  # a decimal
        return round(float(x), 5) + 0.0
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "VARCHAR[]": "array<string>", '"NULL"': "double", "INTEGER": "int"}


def compare(spark, d: str, run, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    df = run(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = connect(d)
    rel = c.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} {sorted(rel.columns)}"]
    types = {n: KINDS.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types, strict=True)}
    if diff := {n: (t, types[n]) for n, t in df.dtypes if types[n] != t}:
        out.append(f"types {diff}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} {len(want)}")
    bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {str(bad[0])[:400]}")
    return out
