"""Rates of outcomes. Every rate is a sum of 0/1 columns over a count, so one pass gives all of them and resampling needs the sums only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Rows where the condition holds, over all rows."""
    return F.count(F.when(condition, 1)) / F.count("*")


def outcome_rates(scored: DataFrame, *by: str) -> DataFrame:
    """n, phi (follow), psi (restore), delta (derail), and sigma (changed), the last counted independently."""
    o = F.col("outcome")
    return scored.groupBy(*by).agg(F.count("*").alias("n"), share(o == "F").alias("phi"), share(o == "R").alias("psi"), share(o == "D").alias("delta"), share(F.col("changed")).alias("sigma"))


def outcome_counts(scored: DataFrame, *by: str, policy: str = "worst") -> DataFrame:
    """Counts and rates with missing answers charged to derailment ("worst") or left out ("complete")."""
    missing = F.col("ans_treat").isNull()
    rows = scored.withColumn("use", F.lit(True) if policy == "worst" else ~missing)
    n_of = lambda x: F.count(F.when(F.col("use") & (F.col("outcome") == x), 1))
    out = rows.groupBy(*by).agg(n_of("F").alias("follow"), n_of("R").alias("restore"), n_of("D").alias("derail"), F.count(F.when(missing, 1)).alias("no_response"), F.countDistinct(F.when(F.col("use"), F.col("problem_id"))).alias("nprob"))
    n = F.col("follow") + F.col("restore") + F.col("derail")
    return out.withColumn("n", n).withColumns({"phi": F.try_divide("follow", "n"), "psi": F.try_divide("restore", "n"), "delta": F.try_divide("derail", "n"), "sigma": F.try_divide(F.col("follow") + F.col("derail"), F.col("n"))})


RATES_SQL = """count(*) AS n, count(*) FILTER (WHERE outcome = 'F')::DOUBLE / count(*) AS phi, count(*) FILTER (WHERE outcome = 'R')::DOUBLE / count(*) AS psi,
  count(*) FILTER (WHERE outcome = 'D')::DOUBLE / count(*) AS delta, count(*) FILTER (WHERE changed)::DOUBLE / count(*) AS sigma"""


def counts_sql(policy: str, where: str = "recount", source: str = "scored") -> str:
    use = "true" if policy == "worst" else "ans_treat IS NOT NULL"
    return f"""
SELECT model, follow, restore, derail, no_response, nprob, follow + restore + derail AS n, follow::DOUBLE / (follow + restore + derail) AS phi, restore::DOUBLE / (follow + restore + derail) AS psi,
  derail::DOUBLE / (follow + restore + derail) AS delta, (follow + derail)::DOUBLE / (follow + restore + derail) AS sigma
FROM (SELECT model, count(*) FILTER (WHERE {use} AND outcome = 'F') AS follow, count(*) FILTER (WHERE {use} AND outcome = 'R') AS restore, count(*) FILTER (WHERE {use} AND outcome = 'D') AS derail,
  count(*) FILTER (WHERE ans_treat IS NULL) AS no_response, count(DISTINCT problem_id) FILTER (WHERE {use}) AS nprob FROM {source} WHERE {where} GROUP BY model)
"""
