"""Comparison of a query's rows with the oracle's, by columns in order of name and rows in order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns: list[str], data) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str(tuple(_plain(r[i]) for i in order)) for r in data)


def differences(spark, con, sf_dir: str, run, sql: str) -> str | None:
    df = run(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if ours == theirs:
        return None
    odd = [(a, b) for a, b in zip(ours[1], theirs[1], strict=False) if a != b][:2]
    return f"{ours[0]} {theirs[0]} rows {len(ours[1])} {len(theirs[1])} {odd}"
