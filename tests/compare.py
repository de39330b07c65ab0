"""Running a query in Spark and its oracle in DuckDB and comparing the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(round(v, 6)) if isinstance(v, float) else str(v)) for v in row)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def differences(df, con, sql, limit: int = 5, tolerance: float = 1e-9) -> list[str]:
    """What differs between the Spark result and the oracle; empty if they agree."""
    s_cols, s_rows = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    d_cols, d_rows = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if s_cols != d_cols:
        return [f"columns {s_cols} != {d_cols}"]
    if len(s_rows) != len(d_rows):
        return [f"{len(s_rows)} rows != {len(d_rows)} rows"]
    out = []
    for s, d in zip(s_rows, d_rows):
        if not all(_same(a, b, tolerance) for a, b in zip(s, d)):
            out.append(f"{dict(zip(s_cols, s))} != {dict(zip(d_cols, d))}")
            if len(out) == limit:
                break
    return out


def _same(a, b, tolerance):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return type(a) is type(b) and a == b
