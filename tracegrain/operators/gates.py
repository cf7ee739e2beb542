"""Which scored items count, and what an answer did: follow (F), restore (R) or derail (D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.equality import eq_le, eq_rel, le, rel


def outcome(answer="ans_treat", target="den_treat", clean="den_clean") -> Column:
    """Follow is tested first; a missing answer derails."""
    return F.when(eq_rel(answer, target), "F").when(eq_rel(answer, clean), "R").otherwise("D")


def strict_gate() -> Column:
    """The main gate without competence: a value on both sides, clean agreement, an edit that moves the value, not copyable."""
    return (F.col("status") == "built") & F.col("den_clean").isNotNull() & F.col("den_treat").isNotNull() & eq_rel("ans_control", "den_clean") & ~eq_rel("den_treat", "den_clean")


def plain_gate() -> Column:
    """The recount's gate: built, and clean agreement within an absolute tolerance."""
    return (F.col("status") == "built") & eq_le("ans_control", "den_clean")


def scored(items: DataFrame) -> DataFrame:
    """Items with both gates, the outcome, and whether the answer changed at all (computed apart from the outcome)."""
    return items.withColumns({"gated": F.coalesce(strict_gate(), F.lit(False)), "recount": F.coalesce(plain_gate(), F.lit(False)), "outcome": outcome(), "changed": ~eq_rel("ans_treat", "ans_control")})


OUTCOME_SQL = f"CASE WHEN {rel('ans_treat', 'den_treat')} THEN 'F' WHEN {rel('ans_treat', 'den_clean')} THEN 'R' ELSE 'D' END"
SCORED_SQL = f"""
SELECT *, coalesce(status = 'built' AND den_clean IS NOT NULL AND den_treat IS NOT NULL AND {rel("ans_control", "den_clean")} AND NOT {rel("den_treat", "den_clean")}, false) AS gated,
  status = 'built' AND {le("ans_control", "den_clean")} AS recount, {OUTCOME_SQL} AS outcome, NOT {rel("ans_treat", "ans_control")} AS changed
FROM items
"""
