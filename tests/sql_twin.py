"""Runs a query and its SQL over the same tables and compares all rows."""

import os
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def norm(v: object) -> object:
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace("+00:00", "")
    return v


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf).iterdir()):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert mine == sorted(repr(tuple(norm(r[k]) for k in place)) for r in found.fetchall())
