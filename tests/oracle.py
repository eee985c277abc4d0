"""Compare a query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
    return con


def _norm(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_norm(v) for v in x) + "]"
    if hasattr(x, "asDict"):
        return _norm(list(x.asDict().values()))
    if isinstance(x, dict):
        return _norm(list(x.values()))
    return f"{type(x).__name__}:{x}"


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    rel = con.sql(sql)
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(a)} and {len(b)} rows; only in Spark {[x for x in a if x not in sb][:3]}; only in SQL {[x for x in b if x not in sa][:3]}"
    return None
