"""What sensitivities determine about the order of systems. The tables here have one row a system, so a few dozen at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded(counts: DataFrame, corrected: bool) -> DataFrame:
    """(model, sigma, m): m is the least of sigma and the exact upper limit of derailment, with counts scaled down by the
    design effect (items for each problem) where ``corrected``."""
    from tracegrain.operators.inference import upper

    deff = F.col("n") / F.greatest(F.col("nprob"), F.lit(1))
    if corrected:
        counts = counts.withColumns({"c_eff": F.greatest(F.lit(0), F.bround(F.col("derail") / deff).cast("bigint")), "n_eff": F.greatest(F.lit(1), F.bround(F.col("n") / deff).cast("bigint"))})
    else:
        counts = counts.withColumns({"c_eff": F.col("derail"), "n_eff": F.col("n")})
    return counts.withColumn("m", F.least("sigma", upper("c_eff", "n_eff")))


BOUNDED_SQL = {
    False: "SELECT model, sigma, phi, delta, n, derail AS c, n AS n_eff FROM counts",
    True: "SELECT model, sigma, phi, delta, n, greatest(0, round_even(derail / (n::DOUBLE / nprob), 0))::BIGINT AS c, greatest(1, round_even(n / (n::DOUBLE / nprob), 0))::BIGINT AS n_eff FROM counts",
}


def held(systems: DataFrame) -> DataFrame:
    """The same rows, computed once and held by the driver: one row a system and setting, so few whatever the records are."""
    return systems.sparkSession.createDataFrame(systems.collect(), systems.schema)


def forced(systems: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs (hi, lo) whose order is determined: sigma of the lower lies below sigma - m of the higher."""
    by = by or []
    a = systems.select(*by, F.col("model").alias("hi"), F.col("sigma").alias("s_hi"), F.col("m").alias("m_hi"))
    b = systems.select(*by, F.col("model").alias("lo"), F.col("sigma").alias("s_lo"))
    joined = a.join(b, by) if by else a.join(b, F.col("s_lo") < F.col("s_hi") - F.col("m_hi"))
    return joined.where((F.col("hi") != F.col("lo")) & (F.col("s_lo") < F.col("s_hi") - F.col("m_hi")))


def adjacent(systems: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Neighbours in the order of sigma, and whether their order is determined."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("sigma").desc(), "model")
    t = systems.withColumns({"next": F.lead("model").over(w), "next_sigma": F.lead("sigma").over(w)}).where("next is not null")
    return t.select(*(by or []), "model", "next", (F.col("sigma") - F.col("next_sigma")).alias("margin"), "m", (F.col("next_sigma") < F.col("sigma") - F.col("m")).alias("determined"))


def linear_extensions(systems: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """How many rankings of the k systems the determined pairs admit: (by, rankings), as a decimal of 38 digits.

    Systems that no pair determines stand anywhere: placing each of them multiplies the rankings of the others by the number of places there
    are. Of the others, sets already placed are bit masks; each round places one more system, if all that must precede it are in
    the mask, and adds up the ways. So the states are the sets that are closed under what precedes, not k! rankings; a mask has room for 62
    systems beside the free ones."""
    by = by or []
    pairs = forced(systems, by)
    tied = pairs.select(*by, F.explode(F.array("hi", "lo")).alias("model")).distinct()
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("model")
    idx = systems.join(tied, [*by, "model"], "left_semi").select(*by, "model", (F.row_number().over(w) - 1).alias("bit"))
    need = pairs.join(idx.withColumnRenamed("model", "hi").withColumnRenamed("bit", "bit_hi"), [*by, "hi"]).groupBy(*by, F.col("lo").alias("model")).agg(F.sum(F.expr("shiftleft(1L, bit_hi)")).alias("need"))
    own = idx.join(need, [*by, "model"], "left")
    wide = F.assert_true(F.col("bit") < 62, F.lit("at most 62 systems may be tied to others"))
    own = own.select(*by, F.struct(F.expr("shiftleft(1L, bit)").alias("bit"), F.coalesce("need", F.lit(0)).cast("bigint").alias("need"), wide.alias("ok")).alias("s"))
    table = own.groupBy(*by).agg(F.collect_list("s").alias("systems"))
    # Groups without a determined pair have free systems only.
    table = systems.groupBy(*by).agg(F.count("*").alias("all")).join(table, by, "left") if by else systems.agg(F.count("*").alias("all")).join(table, F.lit(True), "left")
    size = F.coalesce(F.size("systems"), F.lit(0))
    one = F.lit(1).cast("decimal(38,0)")
    places = F.when(F.col("all") > size, F.sequence(size + 1, F.col("all").cast("int"))).otherwise(F.array().cast("array<int>"))
    free = F.aggregate(places, one, lambda acc, x: (acc * x).cast("decimal(38,0)"))
    ways = table.select(*by, F.coalesce("systems", F.array().cast("array<struct<bit: bigint, need: bigint, ok: void>>")).alias("systems"), free.alias("free"), F.lit(0).cast("bigint").alias("mask"), one.alias("ways"))
    done = ways.where(F.size("systems") == 0).select(*by, "free", "ways")
    for placed in range(1, k + 1):
        step = ways.select(*by, "systems", "free", "mask", "ways", F.inline(F.col("systems")))
        step = step.where((F.col("mask").bitwiseAND(F.col("bit")) == 0) & (F.col("mask").bitwiseAND(F.col("need")) == F.col("need")))
        ways = step.groupBy(*by, "systems", "free", F.col("mask").bitwiseOR(F.col("bit")).alias("mask")).agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        done = done.unionByName(ways.where(F.size("systems") == placed).select(*by, "free", "ways"))
    return done.select(*by, (F.col("free") * F.col("ways")).cast("decimal(38,0)").alias("rankings"))


def extensions_sql(systems: str, by: str = "1") -> str:
    """CTEs giving ``rankings(by, rankings)``: every admissible ranking is grown as a row of its own."""
    return f"""
ext_sys AS (SELECT {by} AS grp, model, sigma, m, row_number() OVER (PARTITION BY {by} ORDER BY model) - 1 AS bit FROM {systems}),
ext_need AS (SELECT a.grp, a.model, a.bit, coalesce(sum(1::BIGINT << b.bit) FILTER (WHERE b.model IS NOT NULL), 0)::BIGINT AS need
  FROM ext_sys a LEFT JOIN ext_sys b ON a.grp = b.grp AND b.model <> a.model AND a.sigma < b.sigma - b.m GROUP BY a.grp, a.model, a.bit),
ext_grow AS (SELECT DISTINCT grp, 0::BIGINT AS mask, 0 AS placed FROM ext_sys
  UNION ALL SELECT g.grp, g.mask | (1::BIGINT << n.bit), placed + 1 FROM ext_grow g JOIN ext_need n ON n.grp = g.grp AND (g.mask & (1::BIGINT << n.bit)) = 0 AND (g.mask & n.need) = n.need),
rankings AS (SELECT grp, count(*) AS rankings FROM ext_grow WHERE placed = (SELECT max(placed) FROM ext_grow) GROUP BY grp)
"""
