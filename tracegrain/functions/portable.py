"""Random choices that every engine repeats: the first 32 bits of an MD5 sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(*parts) -> Column:
    """A number below 2**32 that depends on the parts, joined by colons."""
    key = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def h_sql(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8))::BIGINT"
