"""Comparing a query with its SQL: the same columns, and the same rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with every table of a data directory as a view."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    return con


def plain(value):  # noqa: ANN001, ANN201
    """A value as text that both engines give alike."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return "inf" if math.isinf(value) else f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str | None:  # noqa: ANN001
    """What differs, or None."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        only = [r for r in ours[1] if r not in theirs[1]][:2], [r for r in theirs[1] if r not in ours[1]][:2]
        return f"{len(ours[1])} and {len(theirs[1])} rows; only here {only[0]}, only there {only[1]}"
    return None
