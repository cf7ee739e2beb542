"""Overlap of boxes and as-of joins against plain loops, with a hot page and a hot key."""

import random

from pyspark.sql import functions as F

from tracegrain.operators import joins

BOX = "page long, word_id long, x0 double, y0 double, x1 double, y1 double"


def collide(a, b, share):
    across, down = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    area = lambda r: max((r[4] - r[2]) * (r[5] - r[3]), 1e-9)
    if across <= 0 or down <= 0 or across * down < share * min(area(a), area(b)):
        return False
    ta, tb = a[5] - a[3], b[5] - b[3]
    small, big = (a, b) if ta < tb else (b, a)
    return not (min(ta, tb) / max(ta, tb) < 0.85 and small[2] >= big[2] - 2 and small[4] <= big[4] + 2)


def boxes(n, seed=1):
    """A third of them on one page that grows downwards, the others on pages of their own; some high, wide, flat or upside down."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        x, y = rng.uniform(-50, 500), rng.uniform(0, n / 4 if hot else 100)
        wide, high = rng.choice([(30, 8), (20, 10), (6, 3), (400, 9), (12, 60), (10, 0), (15, -4)])
        out.append((0 if hot else 1 + i // 60, i, x, y, x + wide, y + high))
    return out


def test_overlap_needs_shared_area(spark):
    rows = [(0, 1, 0.0, 0.0, 100.0, 10.0), (0, 2, 50.0, 5.0, 150.0, 15.0), (0, 3, 0.0, 300.0, 10.0, 310.0), (1, 4, 0.0, 0.0, 100.0, 10.0), (0, 5, 0.0, 0.0, 100.0, 100.0), (0, 6, None, 0.0, 100.0, 10.0), (None, 7, 0.0, 0.0, 100.0, 10.0)]
    t = spark.createDataFrame(rows, BOX)
    assert sorted((r.word_a, r.word_b) for r in joins.overlapping_boxes(t, share=0.2).collect()) == [(1, 2), (2, 5)]
    assert joins.overlapping_boxes(t.limit(0)).count() == 0


def test_overlap_across_bands_and_strips(spark, monkeypatch):
    """Bands of a few boxes and narrow strips: each pair once, wherever the bounds lie; pairs looked at a few at a time."""
    rows = boxes(1500)
    by_page = {}
    for r in rows:
        by_page.setdefault(r[0], []).append(r)
    want = sorted((a[1], b[1]) for own in by_page.values() for i, a in enumerate(own) for b in own[i + 1 :] if collide(a, b, 0.3))
    monkeypatch.setattr(joins, "TOGETHER", 100)
    for strip, band in ((256.0, 50_000), (40.0, 64), (1000.0, 128)):
        got = [(r.word_a, r.word_b) for r in joins.overlapping_boxes(spark.createDataFrame(rows, BOX).repartition(5), strip=strip, band=band).collect()]
        assert sorted(got) == want and len(want) > 200


def test_hot_page_is_dealt_out(spark):
    """A third of all boxes on one page: no band holds three times what the middle one does."""
    t = spark.createDataFrame(boxes(12_000), BOX).repartition(4)
    seen = []
    held = joins._sweep
    try:
        joins._sweep = lambda share: lambda batches: iter([__import__("pyarrow").RecordBatch.from_pydict({"page": [0], "word_a": [sum(b.num_rows for b in batches)], "word_b": [0]})])
        seen = sorted(r.word_a for r in joins.overlapping_boxes(t, band=512).collect())
    finally:
        joins._sweep = held
    seen = [x for x in seen if x]
    assert len(seen) > 15 and seen[-1] <= 3 * seen[len(seen) // 2]


def test_repeated_words_meet(spark):
    """Boxes that share page and word_id are boxes of their own."""
    t = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0)] * 2, BOX)
    assert [tuple(r) for r in joins.overlapping_boxes(t).collect()] == [(0, 1, 1)]


def test_as_of(spark):
    """A key with most rows, keys on one side only, ties, nulls, and any number of ranges."""
    rng = random.Random(3)
    left = [(rng.choice(["hot"] * 6 + ["a", "b", "left", None]), rng.randrange(400), i) for i in range(900)] + [("a", None, 900)]
    right = [(rng.choice(["hot"] * 6 + ["a", "b", "right", None]), rng.randrange(400), i) for i in range(300)] + [("a", None, 300)]
    want = set()
    for k, at, i in left:
        met = [(a, j) for key, a, j in right if key == k and k is not None and at is not None and a is not None and a <= at]
        want.add((k, at, i, max(met)[1] if met else None))
    for n in (1, 4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            l, r = (spark.createDataFrame(x, "k string, at int, id int").repartition(3) for x in (left, right))
            got = joins.as_of(l, r, "k", "at", {"id": "met"})
            assert got.columns == ["k", "at", "id", "met"] and {tuple(x) for x in got.collect()} == want
            assert joins.as_of(l, r.limit(0), "k", "at", {"id": "met"}).where("met is not null").count() == 0
            assert joins.as_of(l.limit(0), r, "k", "at", {"id": "met"}).count() == 0
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_key_has_many_ranges(spark):
    """One key of all rows: a window holds the rows of one range, and the last start is carried over."""
    log = spark.range(20_000).select(F.lit("t").alias("task_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"))
    got = joins.durations(log.where("seq % 100 <> 0"), log.where("seq = 0"))
    assert got.count() == 19_800 and got.where("start_seq <> 0 or duration_s <> seq").count() == 0
