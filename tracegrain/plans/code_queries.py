"""Queries on short programs made of the part table, and the remaining gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions.equality import eq_le, eq_rel, le, rel
from tracegrain.functions.portable import h, h_sql
from tracegrain.operators import ranking as rank
from tracegrain.operators.codedom import build_json, condition_text, stated_json
from tracegrain.operators.gates import scored
from tracegrain.plans.inference_queries import M, systems
from tracegrain.plans.rate_queries import items
from tracegrain.plans.registry import query
from tracegrain.sources.fixtures import table
from tracegrain.sources.scratch import by_text, ship_code


def programs(spark, sf):
    """(p_partkey, source, test): straight programs and, every second, one with a loop; every seventh test is wrong, every eleventh program does not parse."""
    key, a, s = F.col("p_partkey"), 2 + F.col("p_partkey") % 5, F.col("p_size")
    t = lambda x: x.cast("string")
    straight = F.concat(F.lit("def f(x):\n    y = x * "), t(a), F.lit("\n    z = 1 + 1\n    return y + 7\n"))
    loop = F.concat(F.lit("Here it is:\n```python\ndef f(n):\n    s = 0\n    for i in [1, 2, 3]:\n        s += n * i\n    r = s - "), t(a), F.lit("\n    return r\n```\n"))
    source = F.when(key % 11 == 0, "def f(x):\n    return (x").when(key % 2 == 1, loop).otherwise(straight)
    right = F.when(key % 2 == 1, 6 * s - a).otherwise(s * a + 7)
    test = F.concat(F.lit("assert f("), t(s), F.lit(") == "), t(right + F.when(key % 7 == 0, 1).otherwise(0)))
    return table(spark, sf, "part").select("p_partkey", source.alias("source"), test.alias("test"))


def built(spark, sf):
    """Programs with what was built from them as JSON; without an item it holds the parse flag only."""
    ship_code(spark)
    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("source", "test"))
    t = by_text(programs(spark, sf).select("p_partkey", *texts), lambda t: t.withColumn("j", build_json("source", "test")), "source", "test")
    return t.select("p_partkey", "j", F.get_json_object("j", "$.length").isNotNull().alias("has_item"))


_OK = "p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"
_A, _ODD = "(2 + p_partkey % 5)", "p_partkey % 2 = 1"


@query(
    f"""SELECT p_partkey, CASE WHEN {_ODD} THEN 6 * p_size - {_A} ELSE p_size * {_A} + 7 END::BIGINT AS den_clean, CASE WHEN {_ODD} THEN 6 * (p_size + 3) - {_A} ELSE (p_size + 3) * {_A} + 7 END::BIGINT AS den_treat,
  CASE WHEN {_ODD} THEN -{_A} ELSE {_A} * {_A} + 7 END::BIGINT AS den_copyable, CASE WHEN {_ODD} THEN 'n' ELSE 'x' END AS edited, CASE WHEN {_ODD} THEN 4 ELSE 3 END::BIGINT AS length FROM part WHERE {_OK}"""
)
def c08_build_code_items(spark, sf):
    """One item for each program whose test holds, edited where its first assignment stands."""
    at = lambda k, kind: F.get_json_object("j", f"$.{k}").cast(kind).alias(k)
    return built(spark, sf).where("has_item").select("p_partkey", at("den_clean", "bigint"), at("den_treat", "bigint"), at("den_copyable", "bigint"), at("edited", "string"), at("length", "bigint"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE {_OK}) AS n_built, count(*) FILTER (WHERE p_partkey % 11 = 0) AS n_unparsed FROM part")
def c01_code_survival(spark, sf):
    n_of = lambda c: F.count(F.when(c, 1))
    return built(spark, sf).agg(F.count("*").alias("n"), n_of(F.col("has_item")).alias("n_built"), n_of(F.get_json_object("j", "$.parsed") == "false").alias("n_unparsed"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '[' || o_custkey || ', 2]' WHEN 1 THEN '\"' || o_orderpriority || '\"' END AS answer FROM orders")
def c09_code_answer(spark, sf):
    """The literal that a reply states."""
    key = F.col("o_orderkey") % 3
    text = F.concat(F.lit("The result is foo(1).\n"), F.when(key == 0, F.concat(F.lit("Final result: ("), F.col("o_custkey").cast("string"), F.lit(", 2)."))).when(key == 1, F.concat(F.lit("so\n'"), "o_orderpriority", F.lit("'"))).otherwise("no idea here"))
    return table(spark, sf, "orders").select("o_orderkey", stated_json(text).alias("answer"))


@query(
    f"""SELECT p_partkey, concat('STATE: ', chr(123), '"', CASE WHEN {_ODD} THEN 'n' ELSE 'x' END, '":', p_size + 3, chr(125), chr(10), 'TAIL:', chr(10),
  CASE WHEN {_ODD} THEN concat('s = 0', chr(10), 'for i in [1, 2, 3]:', chr(10), '    s += n * i', chr(10), 'r = s - ', {_A}, chr(10), 'return r')
  ELSE concat('y = x * ', {_A}, chr(10), 'z = 1 + 1', chr(10), 'return y + 7') END) AS prompt FROM part WHERE {_OK}"""
)
def c10_code_prompt(spark, sf):
    """The edited state and the program's own rest, from the resume point on."""
    at = lambda k: F.get_json_object("j", f"$.{k}")
    return built(spark, sf).where("has_item").select("p_partkey", condition_text(at("state"), at("rest")).alias("prompt"))


@query(f"SELECT model, count(*) AS n, count(*) FILTER (WHERE gated) AS strict, count(*) FILTER (WHERE recount) AS recount, count(*) FILTER (WHERE gated <> recount) AS differ, count(*) FILTER (WHERE gated AND competent) AS competent, count(*) FILTER (WHERE {rel('ans_control', 'den_clean')}) AS agree FROM scored GROUP BY model", "scored")
def f01_gates(spark, sf):
    n_of = lambda c: F.count(F.when(c, 1))
    return scored(items(spark, sf)).groupBy("model").agg(
        F.count("*").alias("n"), n_of(F.col("gated")).alias("strict"), n_of(F.col("recount")).alias("recount"), n_of(F.col("gated") != F.col("recount")).alias("differ"), n_of(F.col("gated") & F.col("competent")).alias("competent"), n_of(eq_rel("ans_control", "den_clean")).alias("agree")
    )


@query("SELECT model, outcome, count(*) AS n FROM scored WHERE gated GROUP BY model, outcome", "scored")
def f03_classify(spark, sf):
    return scored(items(spark, sf)).where("gated").groupBy("model", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT model, den_clean, CASE {h_sql("'human'", "model", "record_id")} % 10 WHEN 0 THEN NULL WHEN 1 THEN den_clean + 1 ELSE den_clean END AS human FROM items WHERE status = 'built')
SELECT model, count(*) AS n_rows, count(human) AS n_filled, count(*) FILTER (WHERE {le("human", "den_clean", "1e-6")})::DOUBLE / count(human) AS agreement FROM s GROUP BY model""",
    "items",
)
def f12_sheet_agreement(spark, sf):
    """Rows of an audit sheet that a person filled in, and whether the parser's value is theirs."""
    u = h("human", F.col("model"), F.col("record_id")) % 10
    s = items(spark, sf).where("status = 'built'").select("model", "den_clean", F.when(u == 0, None).when(u == 1, F.col("den_clean") + 1).otherwise(F.col("den_clean")).alias("human"))
    return s.groupBy("model").agg(F.count("*").alias("n_rows"), F.count("human").alias("n_filled"), (F.count(F.when(eq_le("human", "den_clean", 1e-6), 1)) / F.count("human")).alias("agreement"))


@query(
    f"""WITH {M}, b AS (SELECT model, sigma AS hi, sigma - m AS lo, row_number() OVER (ORDER BY model) - 1 AS bit FROM sys),
grow AS (SELECT 0::BIGINT AS mask, 2.0::DOUBLE AS room, 0 AS placed UNION ALL SELECT mask | (1::BIGINT << bit), least(hi, room), placed + 1 FROM grow JOIN b ON (mask & (1::BIGINT << bit)) = 0 AND least(hi, room) >= lo)
SELECT count(*) AS realisable, (SELECT count(*) FROM b) AS n_systems FROM grow WHERE placed = (SELECT count(*) FROM b)""",
    "scored",
)
def r04_realisable(spark, sf):
    """Orders that some choice of values inside the intervals realises, falling from first to last.

    How far the next value may rise depends on which systems stand before it only, so sets of systems are states."""
    s = systems(spark, sf)
    k = s.count()
    own = s.select(F.struct(F.lit(0).alias("x"), "model", F.col("sigma").alias("hi"), (F.col("sigma") - F.col("m")).alias("lo")).alias("s")).agg(F.array_sort(F.collect_list("s")).alias("systems"))
    ways = own.select("systems", F.lit(0).cast("bigint").alias("mask"), F.lit(2.0).alias("room"), F.lit(1).cast("bigint").alias("ways"))
    for _ in range(k):
        step = ways.select("systems", "mask", "room", "ways", F.posexplode("systems").alias("i", "s")).withColumn("bit", F.expr("shiftleft(1L, i)"))
        step = step.where((F.col("mask").bitwiseAND(F.col("bit")) == 0) & (F.least("s.hi", "room") >= F.col("s.lo")))
        ways = step.groupBy("systems", F.col("mask").bitwiseOR(F.col("bit")).alias("mask")).agg(F.min(F.least("s.hi", "room")).alias("room"), F.sum("ways").alias("ways"))
    return ways.select(F.col("ways").alias("realisable"), F.lit(k).cast("bigint").alias("n_systems"))
