"""Reasoning-trace tables derived from the star-schema tables, in SQL that Spark and DuckDB read alike.

Every line item is one item. Its problem is one of 200, its slot grows with the order key, and items of one system that fall on the
same problem, seed and slot are attempts, numbered in order; the number is part of the record's id.

``view(spark, sf_dir, name)`` gives a DataFrame; ``text(name)`` gives the SQL over tables of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BASE = """
  SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS k,
         CAST(l_linenumber % 4 AS BIGINT) AS s, CAST(CAST(l_quantity AS BIGINT) % 3 AS BIGINT) AS extra, CAST(l_suppkey % 6 AS INT) AS m,
         CAST((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 100 AS INT) AS u,
         CAST((l_partkey * 13 + l_orderkey * 7 + l_linenumber * 3) % 100 AS INT) AS w,
         concat('p', CAST(l_partkey % 200 AS STRING)) AS problem_id, CAST(CASE WHEN l_suppkey % 6 = 3 AND l_linenumber % 3 = 2 AND l_partkey % 200 >= 150 THEN 0 ELSE l_linenumber % 3 END AS INT) AS seed, CAST(floor(l_orderkey / 900) AS INT) AS slot"""

_DEN = """den AS (SELECT panel.*, 7 * q + s + extra AS dc, 7 * q + s + extra + 3 AS dt FROM panel)
"""

_PANEL = f"""
WITH base AS ({_BASE}
  FROM {{lineitem}}),
panel AS (
  SELECT base.*, CAST(row_number() OVER (PARTITION BY m, problem_id, seed, slot ORDER BY l_orderkey, l_linenumber, l_suppkey, q, u, w) - 1 AS INT) AS rn FROM base),
{_DEN}"""

#: The same panel over line items that ``numbered`` has numbered.
_NUMBERED_PANEL = f"""
WITH panel AS ({_BASE}, rn
  FROM {{lineitem}}),
{_DEN}"""

VIEWS = {
    "items": _PANEL
    + """
SELECT concat('sys', CAST(m AS STRING)) AS model, problem_id, seed, concat_ws(':', problem_id, CAST(seed AS STRING), CAST(slot AS STRING), CAST(rn AS STRING)) AS record_id,
       CASE WHEN w < 8 THEN 'unparsed' WHEN w < 14 THEN 'inconsistent'
            WHEN dt IN (7, q, 7 * q + 3, s, 7 * q + s) OR (k <> 7 AND dt IN (4, k, 4 * k)) OR (extra >= 1 AND dt IN (1, 7 * q + s + 1)) OR (extra >= 2 AND dt = 7 * q + s + 2) THEN 'copyable'
            ELSE 'built' END AS status,
       CAST(dc AS DOUBLE) AS den_clean, CAST(dt AS DOUBLE) AS den_treat, CAST(CASE WHEN k <> 7 THEN dc END AS DOUBLE) AS den_placebo, CAST(dc + 3 AS DOUBLE) AS den_copyable,
       CAST(CASE WHEN w % 23 = 22 THEN dc + 1 ELSE dc END AS DOUBLE) AS ans_control,
       CAST(CASE WHEN u >= 98 THEN NULL WHEN u < 5 + 8 * m THEN dt WHEN u < 17 + 6 * m THEN dc + 11 ELSE dc END AS DOUBLE) AS ans_treat,
       CAST(CASE WHEN k = 7 OR w % 11 = 10 THEN NULL WHEN w % 13 = 12 THEN dt ELSE dc END AS DOUBLE) AS ans_placebo,
       CAST(CASE WHEN w % 7 = 6 THEN NULL WHEN (m = 5 AND (u * 7 + w) % 100 < 46) OR (m <> 5 AND u < 40) THEN dc + 3 ELSE dc END AS DOUBLE) AS ans_copyable,
       CAST(CASE WHEN u % 2 = 0 THEN dc ELSE dt END AS DOUBLE) AS ans_legacy, CAST(CASE WHEN w % 29 = 28 THEN NULL ELSE dc END AS DOUBLE) AS gold,
       u % 3 = 0 AS competent, 0 AS treatment_step_idx, CAST(2 + extra + CASE WHEN k <> 7 THEN 1 ELSE 0 END AS INT) AS trace_length
FROM den
""",
    "traces": _PANEL
    + """
SELECT concat('sys', CAST(m AS STRING)) AS model, problem_id, concat_ws(':', problem_id, CAST(seed AS STRING), CAST(slot AS STRING), CAST(rn AS STRING)) AS record_id,
  CASE WHEN w < 8 THEN 'no structured content here' ELSE concat('cost = 7 * ', CAST(q AS STRING), ' = ', CAST(7*q AS STRING), chr(10),
   CASE WHEN k <> 7 THEN concat('aside = 4 * ', CAST(k AS STRING), ' = ', CAST(4*k AS STRING), chr(10)) ELSE '' END,
   'total = cost + ', CAST(s AS STRING), ' = ', CAST(7*q+s AS STRING), chr(10),
   CASE WHEN extra >= 1 THEN concat('t1 = total + 1 = ', CAST(7*q+s+1 AS STRING), chr(10)) ELSE '' END,
   CASE WHEN extra >= 2 THEN concat('t2 = t1 + 1 = ', CAST(7*q+s+2 AS STRING), chr(10)) ELSE '' END,
   'The final answer is ', CAST(CASE WHEN w < 14 THEN dc + 1 ELSE dc END AS STRING)) END AS trace,
  CASE WHEN w % 10 = 9 THEN 'no structured content here' ELSE concat('base = ', CAST(s AS STRING), chr(10), 'cost = 7 * ', CAST(q AS STRING), ' = ', CAST(7*q AS STRING), chr(10), 'total = cost + base = ', CAST(7*q+s AS STRING), chr(10),
   'The final answer is ', CAST(CASE WHEN w % 10 = 8 THEN 7*q+s+1 ELSE 7*q+s END AS STRING)) END AS trace_bare,
  rn AS attempt, q, k, s, extra, w, dc, dt
FROM den
""",
    "attempts": "SELECT model, regexp_replace(record_id, ':[0-9]+$', '') AS record_id, attempt, trace, q, k, s, extra, w, dc, dt FROM ({traces}) made",
    "on_policy": """
SELECT concat('e', CAST(user_id AS STRING)) AS problem_id, event_id AS sample,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(user_id % 3 + event_id % 2 AS DOUBLE) END AS denotation,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 10 < 7 THEN CAST(user_id % 3 + event_id % 2 AS DOUBLE) ELSE CAST(user_id % 3 + (event_id + 1) % 2 AS DOUBLE) END AS answer
FROM {events}
""",
    "rollouts": """
SELECT o_orderkey AS rollout_id, concat('c', CAST(o_custkey % 300 AS STRING)) AS problem_id, concat('sys', CAST(o_custkey % 6 AS STRING)) AS model, CAST(o_orderkey % 7 AS DOUBLE) AS ans_full, f AS fraction,
  CASE WHEN (o_orderkey * 13 + o_custkey * 7) % 100 < 100 * f - 5 THEN CAST(o_orderkey % 7 AS DOUBLE) ELSE CAST(99 AS DOUBLE) END AS ans_truncated,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 10 < 3 THEN CAST(99 AS DOUBLE) ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS ans_mistake,
  CASE WHEN o_custkey % 10 < 1 THEN CAST(99 AS DOUBLE) ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS ans_paraphrase,
  CASE WHEN o_custkey % 10 < 7 THEN CAST(99 AS DOUBLE) ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS ans_filler,
  o_orderkey % 5 = 0 AS hint_followed, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 2 = 0 END AS hint_verbalized
FROM {orders} CROSS JOIN (SELECT CAST(0.25 AS DOUBLE) AS f UNION ALL SELECT CAST(0.5 AS DOUBLE) UNION ALL SELECT CAST(0.75 AS DOUBLE) UNION ALL SELECT CAST(1.0 AS DOUBLE)) fr
""",
    "ragged": """
SELECT o_orderkey AS rollout_id, concat('sys', CAST(o_custkey % 6 AS STRING)) AS model, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) END AS full,
  CAST(CASE o_orderkey % 13 WHEN 0 THEN 3 WHEN 5 THEN 5 ELSE 4 END AS INT) AS size, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.2 ELSE 0.125 END AS DOUBLE) AS step
FROM {orders}
""",
    "e0_scores": """
SELECT l.doc_id, l.quality AS label, d.source AS model, CAST(l.quality AS DOUBLE) AS follow_denotation, CAST((l.doc_id * 7 + 20 * l.quality) % 50 AS DOUBLE) AS noisy, CAST(0.5 AS DOUBLE) AS constant
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
""",
    "task_log": """
SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS task_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'stop' ELSE 'event' END AS event FROM {events}
""",
    "boxes": """
SELECT CASE WHEN n % 3 = 0 THEN 0 ELSE 1 + CAST(floor(n / 1400) AS BIGINT) END AS page, n AS word_id, x AS x0, y AS y0,
  CAST(x + CASE WHEN n % 17 = 0 THEN 6 + n % 30 ELSE 20 + (n * 13) % 30 END AS DOUBLE) AS x1, CAST(y + CASE WHEN n % 17 = 0 THEN 3 ELSE 6 + n % 7 END AS DOUBLE) AS y1
FROM (SELECT n, CAST((i % 12) * 40 + (n * 37) % 25 - CASE WHEN n % 17 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS x, CAST(floor(i / 12) * 9 + (n * 11) % 4 AS DOUBLE) AS y
  FROM (SELECT CAST(o_orderkey AS BIGINT) AS n, CAST(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_orderkey / 3) ELSE o_orderkey % 1400 END AS BIGINT) AS i FROM {orders}) numbered) placed
""",
    "verdict_text": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FOLLOWS' WHEN 1 THEN 'It ignores the trace.' WHEN 2 THEN 'At first it follows, but finally IGNORES' ELSE 'unclear' END AS raw_verdict FROM {events}
""",
}

VIEWS["attempts"] = VIEWS["attempts"].replace("{traces}", VIEWS["traces"])

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(lineitem: DataFrame, *more: str) -> DataFrame:
    """The five columns that all others of the panel follow from (and ``more``), m, seed and slot, one whole number for each (m, problem_id, seed, slot) and one
    in the order of (u, w), nulls included."""
    rows = lineitem.sparkSession.sql(f"{_BASE}, {', '.join(('l_partkey', 'l_quantity', *more))} FROM {{lineitem}}", lineitem=lineitem)

    def digit(c, n: int) -> Column:
        """-n to n, or null, as 0 to 2n + 1."""
        return F.coalesce(c + n, F.lit(2 * n + 1))

    group = F.coalesce(F.col("slot").cast("bigint"), F.lit(-(2**31) - 1))
    for c, n in ((F.col("l_partkey") % 200, 199), (F.col("seed"), 2), (F.col("m"), 5)):
        group = group * (2 * n + 2) + digit(c, n)
    tie = F.coalesce("u", F.lit(-100)) * 1000 + F.coalesce("w", F.lit(-100))
    return rows.select(*_SHIPPED[:-1], F.col("q").alias("l_quantity"), *more, "m", "seed", "slot", group.alias("group"), tie.alias("tie"))


_SHIPPED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


def _number(*within: str) -> Column:
    return F.row_number().over(Window.partitionBy(*within, "group").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "tie")) - 1


def numbered(lineitem: DataFrame) -> DataFrame:
    """Line items with the panel's number of each attempt, ``rn``, and the columns that the panel is made of.

    Every row is shuffled and sorted for its number. Only five columns take part, beside two whole numbers: half the bytes, and rows of different
    groups differ in the first key of the sort."""
    return _keyed(lineitem).select(*_SHIPPED, "group", "tie").withColumn("rn", _number())


def numbered_by_run(lineitem: DataFrame, run: Callable[[Column], Column]) -> DataFrame:
    """``numbered`` rows with ``run``, those of a run in one partition, so that what gathers runs needs no shuffle of its own.

    ``run`` makes it of m, seed and what it is given: the third piece of the record's id. That is the slot, or the number where the id lacks problem or slot: such rows
    are numbered before the others, and stay apart from them, for an attempt's number counts within its group."""
    rows = _keyed(lineitem)
    odd = F.col("l_partkey").isNull() | F.col("l_orderkey").isNull()
    before = rows.where(odd).withColumn("given", _number())
    dealt = rows.where(~odd).select(*_SHIPPED, run(F.col("slot")).alias("run"), F.lit(None).cast("int").alias("given"))
    dealt = dealt.unionByName(before.select(*_SHIPPED, run(F.col("given")).alias("run"), "given"))
    # As many partitions as the session says: by what these rows are in bytes Spark would make them fewer, and what is made of them is far larger.
    dealt = dealt.repartition(int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run")
    return _keyed(dealt, "run", "given").select(*_SHIPPED, "run", F.coalesce("given", _number("run")).alias("rn"))


#: Columns of ``items`` that are read as they stand; the others are worked out.
_PLAIN_ITEMS = ("model", "problem_id", "seed", "record_id")


def view(spark: SparkSession, sf_dir: str, name: str, run: Callable[[Column], Column] | None = None) -> DataFrame:
    """A view; with ``run``, items with that column and those of a run in one partition (``numbered_by_run``)."""
    sql, plain = VIEWS[name], _PLAIN_ITEMS
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if _PANEL in sql:
        panel = _NUMBERED_PANEL
        if run:
            panel, plain, sql = panel.replace(", rn\n", ", rn, run\n"), (*plain, "run"), sql.replace("\nFROM den", ", run\nFROM den")
        sql, used["lineitem"] = sql.replace(_PANEL, panel), numbered_by_run(used["lineitem"], run) if run else numbered(used["lineitem"])
    rows = spark.sql(sql, **used)
    if name != "items":
        return rows
    # The optimiser merges projections: each gate and outcome would hold a copy of the cases behind every column it reads, in a method too large
    # to be compiled. A generator of one row isn't merged: each column is worked out once.
    return rows.select(*plain, F.inline(F.array(F.struct(*(c for c in rows.columns if c not in plain)))))


def text(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES})
