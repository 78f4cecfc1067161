"""Comparison of a query with its SQL on the same Parquet tables in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(con: duckdb.DuckDBPyConnection, sf_dir: str) -> None:
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE OR REPLACE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if hasattr(value, "isoformat") else value


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str | None:
    """None if names and rows agree, or what differs."""
    df = query(spark, sf_dir)
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        tables(con, sf_dir)
        cursor = con.execute(sql)
        names, want = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want)
    if got == want:
        return None
    return f"{len(got)} rows against {len(want)}; first differences {[p for p in zip(got, want) if p[0] != p[1]][:2]}"
