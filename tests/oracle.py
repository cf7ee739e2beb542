"""Run a query on Spark and its SQL on DuckDB, and compare rows without regard to order."""

from __future__ import annotations

import math

import duckdb

from tracegrain.sources.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return x.item() if hasattr(x, "item") else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> str:
    """Empty if both agree, else what differs first."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows, such as {got[:2]} and {want[:2]}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{g} and {w}"
        if any(type(a) is not type(b) and a is not None for a, b in zip(g, w, strict=True)):
            return f"types of {[type(x).__name__ for x in g]} and {[type(x).__name__ for x in w]}: {g}"
    return ""
