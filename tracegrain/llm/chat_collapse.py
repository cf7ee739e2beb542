"""Chat formatting of conversation logs, after collapsing cumulative snapshots. Only Spark SQL functions.

A log holds a conversation again and again as it grows. Each turn's fingerprint is the running sum of hashes of (place,
role, text) up to it, in four 32-bit lanes, so the fingerprints of all turn prefixes of a conversation come from one
window. A conversation whose whole fingerprint is another one's proper prefix is dropped by an anti-join; of equal
conversations the smallest conv_id stays. Only then is text put together.

Turns are ordered by turn, then role, then text, nulls first; rows that repeat are turns of their own; a null role or text is
not the empty string, but is rendered as one; rows with a null conv_id are one conversation; very long texts are hashed and rendered
whole; of equal conversations the smallest conv_id stays (null last); an empty table gives no rows; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["place", "f0", "f1", "f2", "f3"]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, f0..f3, n_turns): the fingerprint of the first ``place`` turns of each conversation."""
    own = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", "role", "text", F.row_number().over(own.orderBy("turn", "role", "text")).alias("place"))
    parts = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    for i in (0, 1):
        rows = rows.withColumn(f"h{i}", F.xxhash64(F.lit(i), *parts))
    low = F.lit(0xFFFFFFFF).cast("long")
    lanes = {"f0": F.col("h0").bitwiseAND(low), "f1": F.shiftrightunsigned("h0", 32), "f2": F.col("h1").bitwiseAND(low), "f3": F.shiftrightunsigned("h1", 32)}
    upto = own.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "place", *(F.sum(c).over(upto).alias(k) for k, c in lanes.items()), F.count("*").over(own).alias("n_turns"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that no other conversation continues."""
    seen = prefixes(turns)
    whole = seen.where("place = n_turns").groupBy(*KEY).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id"))["conv_id"].alias("conv_id"), F.count("*").alias("n_copies"))
    started = seen.where("place < n_turns").select(*KEY).distinct()
    return whole.join(started, KEY, "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): each maximal conversation as one training text."""
    kept = collapse(turns).withColumnRenamed("conv_id", "kept_id")
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    whole = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", line), "").alias("rendered"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations),
p AS (SELECT conv_id, place, string_agg(length(role)::VARCHAR || ':' || role || length(text)::VARCHAR || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
        count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM p WHERE place = n_turns GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns))
SELECT kept.conv_id, kept.n_turns, kept.n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM kept JOIN t ON t.conv_id = kept.conv_id GROUP BY kept.conv_id, kept.n_turns, kept.n_copies
"""
