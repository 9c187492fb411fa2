"""Comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v if isinstance(v, (int, str, bool, date)) or v is None else str(v)


def compare(con, sql: str, df) -> list[str]:
    """Differences between the SQL's rows and the frame's, at most a few."""
    cur = con.execute(sql)
    want_cols = [(d[0], str(d[1])) for d in cur.description]
    want = cur.fetchall()
    got_cols = df.dtypes
    problems = []
    names = sorted(n for n, _ in want_cols)
    if names != sorted(n for n, _ in got_cols):
        return [f"columns {sorted(n for n, _ in got_cols)} != {names}"]
    duck = dict(want_cols)
    for n, t in got_cols:
        if TYPES.get(t, t) != duck[n]:
            problems.append(f"type of {n}: spark {t}, sql {duck[n]}")
    w_at = [[n for n, _ in want_cols].index(n) for n in names]
    g_at = [df.columns.index(n) for n in names]
    a = sorted((tuple(_norm(r[i]) for i in w_at) for r in want), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in g_at) for r in df.collect()), key=_key)
    if len(a) != len(b):
        problems.append(f"rows: spark {len(b)}, sql {len(a)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} of {len(a)} rows differ; columns {names}")
        problems += [f"  sql {x}\n  spk {y}" for x, y in bad[:2]]
    return problems
