"""The equality rules for answers. They differ on purpose; an undefined answer never turns a rule's result into null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eq_rel(a, b) -> Column:
    """Relative to the second value; two nulls are equal, one is not."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b)))


def eq_le(a, b, tolerance: float = 1e-9) -> Column:
    """Within an absolute tolerance; false if either is null."""
    return F.coalesce(F.abs(_c(a) - _c(b)) <= tolerance, F.lit(False))


def eq_lt(a, b, tolerance: float = 1e-9) -> Column:
    """Strictly within an absolute tolerance; false if either is null."""
    return F.coalesce(F.abs(_c(a) - _c(b)) < tolerance, F.lit(False))


def finite(x) -> Column:
    """Null in place of NaN and infinities."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def rel(a: str, b: str) -> str:
    """eq_rel as SQL text."""
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN {a} IS NULL AND {b} IS NULL ELSE abs({a} - {b}) <= 1e-9 * greatest(1.0::DOUBLE, abs({b})) END)"


def le(a: str, b: str, tolerance: str = "1e-9") -> str:
    return f"coalesce(abs({a} - {b}) <= {tolerance}, false)"


def lt(a: str, b: str, tolerance: str = "1e-9") -> str:
    return f"coalesce(abs({a} - {b}) < {tolerance}, false)"
