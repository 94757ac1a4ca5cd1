"""Run a registered query in Spark and its SQL in DuckDB and compare the values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 100000 else str(value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str([(k, canonical(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    if type(value).__name__ == "Decimal":
        return canonical(float(value) if value % 1 else int(value))
    return str(value)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(canonical(row[c]) for c in columns) for row in df.collect())


def rows_of_sql(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    return columns, sorted(tuple(canonical(row[i]) for i in order) for row in cursor.fetchall())


def difference(left, right, limit: int = 5) -> str:
    a, b = set(left), set(right)
    return f"{len(left)} vs {len(right)} rows; only spark {sorted(a - b)[:limit]}; only sql {sorted(b - a)[:limit]}"
