"""The register of queries: a name, a DataFrame, and where possible SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracegrain.operators.gates import SCORED_SQL
from tracegrain.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its own name; ``sql`` may use these views (``scored`` stands on ``items``)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return add


def with_views(sql: str, *views: str) -> str:
    """The SQL with the views as its first common table expressions; ``sql`` may go on with CTEs of its own (``AS (..), x AS (..) SELECT``)."""
    parts = []
    for v in views:
        if v == "scored":
            parts += [f"items AS ({fixtures.text('items')})", f"scored AS ({SCORED_SQL})"]
        else:
            parts.append(f"{v} AS ({fixtures.text(v)})")
    body = sql.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH RECURSIVE " + ",\n".join(parts)
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
