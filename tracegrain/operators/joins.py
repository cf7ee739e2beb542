"""Joins that Spark has no operator for: as-of, and overlap of boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.sources.scratch import materialise, ship_code


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, take: dict[str, str]) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key that stands before it: the columns ``take`` of that row under their new names, null
    without one. Of rows at the same place those of ``right`` come first, and of these the one with the largest columns counts.

    Both tables are laid out by (key, order) in ranges, so that a key may have any number of rows; a range begins with the last row of ``right``
    before it, which is one row a range. The window then runs inside (range, key). A row without a place or key meets none."""
    spark = left.sparkSession
    own = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    found = F.struct(*(F.col(c).alias(new) for c, new in take.items()))
    at = (F.col(key).alias("_key"), F.col(order).alias("_at"))
    both = left.select(*at, F.lit(1).alias("_side"), own.alias("_row"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_found"))
    both = both.unionByName(right.select(*at, F.lit(0).alias("_side"), F.lit(None).cast(left.select(own).schema[0].dataType).alias("_row"), found.alias("_found")).dropna(subset=["_key", "_at"]))
    # The ranges have to be the same for all that follows: they are written with their number.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = materialise(both.repartitionByRange(n, "_key", "_at", "_side").withColumn("_range", F.spark_partition_id()), "as-of")
    last = F.max(F.when(F.col("_side") == 0, F.struct("_key", "_at", "_found")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = laid.groupBy("_range").agg(last.alias("_last")).select("_range", F.max("_last").over(before).alias("_last")).where("_last is not null")
    carried = ahead.select("_range", "_last._key", "_last._at", F.lit(0).alias("_side"), F.lit(None).cast(laid.schema["_row"].dataType).alias("_row"), "_last._found")
    w = Window.partitionBy("_range", "_key").orderBy("_at", "_side", "_found").rowsBetween(Window.unboundedPreceding, 0)
    joined = laid.select(*carried.columns).unionByName(carried).withColumn("_found", F.last("_found", ignorenulls=True).over(w))
    return joined.where("_side = 1").select("_row.*", "_found.*")


def durations(stops: DataFrame, starts: DataFrame) -> DataFrame:
    """(task_id, seq, start_seq, duration_s) of each stop that has a start of its task before it, in the order in which they were logged."""
    met = as_of(stops.select("task_id", "seq", "ts"), starts, "task_id", "seq", {"seq": "start_seq", "ts": "start_ts"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return met.where("start_ts is not null").select("task_id", "seq", "start_seq", F.round((micros("ts") - micros("start_ts")) / 1e6, 3).alias("duration_s"))


# The share of the smaller box that a collision covers; a glyph below so much of the other's height, and inside it but
# for so much on either side, is a script; the least area that a box counts with.
SHARE, SCRIPT, MARGIN, LEAST = 0.3, 0.85, 2, 1e-9

#: Width of the strips that a page is cut into, boxes that a band should hold, and of how many boxes one is looked at for the bands' bounds.
STRIP, BAND, LOOKED = 256.0, 50_000, 64
#: Pairs that a sweep looks at together.
TOGETHER = 1_000_000

_BOX = [("page", "long"), ("strip", "long"), ("y0", "double"), ("y1", "double"), ("x0", "double"), ("x1", "double"), ("word_id", "long"), ("left", "long")]


def _place(bounds: np.ndarray, page, strip, y, after: bool) -> np.ndarray:
    """How many bounds (rows of page, strip and y, in order) lie before each key; of equal ones too, if ``after``."""
    m = len(bounds)
    rows = np.concatenate([np.zeros(m, np.int8), np.full(len(page), 1 if after else -1, np.int8)])
    keys = [np.concatenate([bounds[:, k], x]) for k, x in enumerate((page, strip, y))]
    order = np.lexsort((rows, keys[2], keys[1], keys[0]))
    seen = np.cumsum(order < m)
    out = np.empty(len(order), np.int64)
    out[order] = seen
    return out[m:]


def _dealt(bounds: np.ndarray, strip: float):
    """Each box in all strips and bands that it reaches, with the band that it begins in."""

    def run(batches):
        for batch in batches:
            page, word, x0, y0, x1, y1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("page", "word_id", "x0", "y0", "x1", "y1"))
            first, last = (np.floor(x / strip).astype(np.int64) for x in (x0, x1))
            n = np.maximum(last - first, 0) + 1
            row = np.repeat(np.arange(len(n)), n)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            own = _place(bounds, page[row], at, y0[row], True)
            end = np.maximum(_place(bounds, page[row], at, y1[row], False), own)
            k = end - own + 1
            row, at, own, band = np.repeat(row, k), np.repeat(at, k), np.repeat(own, k), np.repeat(own, k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            cols = [page[row], at, y0[row], y1[row], x0[row], x1[row], word[row], first[row], band, own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*(c for c, _ in _BOX), "band", "own"])

    return run


def _sweep(share: float):
    """The collisions of the boxes of each band, which come in the order of their upper edges."""

    def collide(b, i, j):
        across = np.minimum(b["x1"][i], b["x1"][j]) - np.maximum(b["x0"][i], b["x0"][j])
        down = np.minimum(b["y1"][i], b["y1"][j]) - np.maximum(b["y0"][i], b["y0"][j])
        tall = b["y1"] - b["y0"]
        area = np.maximum((b["x1"] - b["x0"]) * tall, LEAST)
        hit = (across > 0) & (down > 0) & (across * down >= share * np.minimum(area[i], area[j]))
        i, j = i[hit], j[hit]
        small, big = np.where(tall[i] < tall[j], i, j), np.where(tall[i] < tall[j], j, i)
        nested = (b["x0"][small] >= b["x0"][big] - MARGIN) & (b["x1"][small] <= b["x1"][big] + MARGIN)
        plain = ~((np.minimum(tall[i], tall[j]) / np.maximum(tall[i], tall[j]) < SCRIPT) & nested)
        return i[plain], j[plain]

    def run(batches):
        table = [x for x in batches if x.num_rows]
        if not table:
            return
        whole = pa.Table.from_batches(table)
        b = {c: whole.column(c).to_numpy() for c in whole.schema.names}
        edge = np.flatnonzero((b["band"][1:] != b["band"][:-1]) | (b["page"][1:] != b["page"][:-1]) | (b["strip"][1:] != b["strip"][:-1])) + 1
        last = np.repeat(np.append(edge, len(b["band"])), np.diff(np.concatenate([[0], edge, [len(b["band"])]])))
        # Behind a box come those that it can meet: of its strip and band, up to the first that begins below it.
        rank = np.arange(len(last))
        until = np.empty(len(last), np.int64)
        for lo, hi in zip(np.concatenate([[0], edge]), np.append(edge, len(last)), strict=True):
            until[lo:hi] = lo + np.searchsorted(b["y0"][lo:hi], b["y1"][lo:hi])
        n = np.maximum(until - rank - 1, 0)
        total, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, "right")))
            i = np.repeat(rank[at:to], n[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
            # A pair counts in the band that the later of both begins in, and in the first strip that both touch.
            once = (b["own"][j] == b["band"][j]) & (np.maximum(b["left"][i], b["left"][j]) == b["strip"][i])
            i, j = collide(b, i[once], j[once])
            a, c = b["word_id"][i], b["word_id"][j]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(b["page"][i]), pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["page", "word_a", "word_b"])
            at = to

    return run


def overlapping_boxes(boxes: DataFrame, share: float = SHARE, strip: float = STRIP, band: int = BAND) -> DataFrame:
    """(page, word_a, word_b): pairs of boxes of a page that cover ``share`` of the smaller one; a small glyph nested in a larger one is no collision.

    Pages are cut into strips of ``strip`` units across, and (page, strip, y0) into bands of about ``band`` boxes: a page of any size is split where its boxes
    are, by bounds read off one box in ``LOOKED`` (a hash of its word_id decides which). A box goes to every band that it reaches into, and
    each band is swept from top to bottom by itself. A box without all four numbers or its page meets none; boxes that share page and word_id are boxes of their own."""
    ship_code(boxes.sparkSession)
    rows = boxes.select(F.col("page").cast("long").alias("page"), F.col("word_id").cast("long").alias("word_id"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).dropna()
    left = F.floor(F.col("x0") / strip)
    looked = max(1, min(LOOKED, band // 64))
    # A few rows for each band.
    seen = rows.where(F.pmod(F.xxhash64("word_id"), F.lit(looked)) == 0).select("page", left.cast("double").alias("strip"), "y0")
    some = max(1, band // looked)
    n = -(-seen.count() // some) + 1
    dealt = seen.repartitionByRange(n, "page", "strip", "y0").withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min(F.struct("page", "strip", "y0")).alias("b"))
    bounds = np.array(sorted(tuple(r.b) for r in dealt.collect())[1:], np.float64).reshape(-1, 3)
    schema = ", ".join(f"{c} {t}" for c, t in _BOX) + ", band long, own long"
    filed = rows.mapInArrow(_dealt(bounds, strip), schema)
    return filed.repartitionByRange(len(bounds) + 1, "band").sortWithinPartitions("band", "page", "strip", "y0").mapInArrow(_sweep(share), "page long, word_a long, word_b long")
