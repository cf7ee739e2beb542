"""Rank statistics. Rows collapse to distinct scores before any window, so ties cost nothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.portable import h
from tracegrain.sources.scratch import materialise


def _below(counted: DataFrame, by: list[str], score: str) -> DataFrame:
    """Adds ``below``: the rows of the group with a smaller score. ``counted`` has one row for each (by, score), with its n.

    Scores are dealt out by range, so that no task has to sort all scores of a group: what lies in the ranges before comes from one
    row for each range, and a window counts inside a range only. The ranges are written, as another run could cut them elsewhere."""
    ranges = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(counted.repartitionByRange(ranges, *by, score).withColumn("_range", F.spark_partition_id()), "score-ranges")
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_range")
    base = dealt.groupBy(*by, "_range").agg(F.sum("n").alias("_n")).withColumn("_base", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    inside = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(base, [*by, "_range"]).withColumn("below", F.col("_base") + F.sum("n").over(inside) - F.col("n")).drop("_range", "_base")


def _with_rank(rows: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """Adds the mean rank of all rows of the group with the same score; rows without a score are dropped.

    A score that fills more than its share of a partition would be one key of a join: there are fewer of these than partitions, and they
    are sent to the rows instead."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [*by, score]
    at = _below(rows.where(F.col(score).isNotNull()).groupBy(*on).agg(F.count("*").alias("n")), by, score)
    at = materialise(at.select(*on, "n", (F.col("below") + (F.col("n") + 1) / 2).alias(name)), "ranks")
    total = at.agg(F.sum("n")).first()[0] or 0
    hot = at.where(F.col("n") * parts > total).drop("n")
    sent = rows.join(F.broadcast(hot), on, "left")
    rest = sent.where(F.col(name).isNull()).drop(name).join(at.drop("n"), on)
    return sent.where(F.col(name).isNotNull()).unionByName(rest)


def mid_ranks(rows: DataFrame, score: str) -> DataFrame:
    """Adds ``mid_rank``: the mean rank of all rows with the same score."""
    return _with_rank(rows, [], score, "mid_rank")


def roc_auc(rows: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """(by, n, auc): the rank-sum form, ties averaged; scores that are not finite are dropped; null with one class only."""
    rows = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    counted = rows.groupBy(by, score).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("int")).alias("n1"))
    t = _below(counted, [by], score).groupBy(by).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("n1") * (F.col("below") + (F.col("n") + 1) / 2)).alias("ranks"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return t.select(by, "n", F.round(F.try_divide(F.col("ranks") - n1 * (n1 + 1) / 2, (n1 * n0).cast("double")), 9).alias("auc"))


def e0_metrics(rows: DataFrame) -> DataFrame:
    """``rows`` (gold, denotation, answer) with 0 or 1 for follow_denotation, question_correct and change_from_gold.

    The answer is at a number if they differ by less than 1e-9; without an answer all three are 0, and an answer without a denotation follows nothing."""
    there = F.col("answer").isNotNull() & ~F.isnan("answer")
    at = lambda c: F.coalesce(there & (F.abs(F.col("answer") - F.col(c)) < 1e-9), F.lit(False))
    score = lambda c: c.cast("double")
    return rows.withColumns({"follow_denotation": score(at("denotation")), "question_correct": score(at("gold")), "change_from_gold": score(there & F.col("gold").isNotNull() & ~at("gold"))})


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, rho): correlation of mid-ranks over complete pairs; null below three pairs or without variance."""
    rows = rows.dropna(subset=[x, y])
    for c, r in ((x, "rx"), (y, "ry")):
        rows = _with_rank(rows, [by], c, r)
    varies = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & varies, F.round(F.corr("rx", "ry"), 9)).alias("rho"))


def early_answering(rolls: DataFrame, by: str, order: str) -> DataFrame:
    """(by, position, fraction, n, at_answer): how many rollouts are at the final answer after each part of the trace.

    ``rolls`` has arrays ``fractions`` and ``truncated`` and the final answer ``full``; two missing answers agree. The first rollout of a group, by ``order``, says which
    fractions there are; rollouts of another length are dropped. One aggregation by (group, length, position) holds all of that, and the few rows it
    leaves are then chosen from."""
    hits = F.transform("truncated", lambda a: a.eqNullSafe(F.col("full")).cast("long"))
    each = rolls.select(by, F.size("truncated").alias("len"), F.struct(F.col(order).alias("at"), F.col("fractions")).alias("first"), F.posexplode_outer(hits).alias("position", "hit"))
    sums = each.groupBy(by, "len", "position").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.min("first").alias("first"))
    fractions = F.min("first").over(Window.partitionBy(by))["fractions"]
    kept = sums.withColumn("fractions", fractions).where("len = size(fractions) and position is not null")
    return kept.select(by, "position", F.get("fractions", F.col("position")).alias("fraction"), "n", (F.col("hits") / F.col("n")).alias("at_answer"))


def margins(tokens) -> Column:
    """The margins between the best two candidates of tokens (array of token, logprob, top: array of log probabilities), in order.

    A token counts with two known candidates, if it has a digit or a probability of its own."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    best = lambda t: F.sort_array(F.filter(t["top"], lambda v: v.isNotNull()), asc=False)
    ranked = F.transform(tokens, lambda t: F.struct((t["token"].rlike("[0-9]") | t["logprob"].isNotNull()).alias("counts"), best(t).alias("v")))
    return F.transform(F.filter(ranked, lambda t: t["counts"] & (F.size(t["v"]) >= 2)), lambda t: t["v"][0] - t["v"][1])


def best_two(counts: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``margins`` over the tokens of many traces at once: which tokens count after all, and their margins. ``top`` has a row for each token, NaN for unknown candidates."""
    kept = counts & ((~np.isnan(top)).sum(axis=1) >= 2)
    v = np.sort(np.where(np.isnan(top[kept]), -np.inf, top[kept]), axis=1)
    return kept, v[:, -1] - v[:, -2]


def attribution(intact, changed) -> Column:
    """Mean distance of two runs' margins over the positions that both have, relative to the mean size of the intact ones; null without any, or if they are zero."""
    n = F.least(F.size(intact), F.size(changed))
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)), n)
    gap = F.zip_with(F.slice(intact, 1, n), F.slice(changed, 1, n), lambda a, b: a - b)
    return F.when(n > 0, F.try_divide(mean(gap), mean(F.slice(intact, 1, n))))


def filled_sample(rows: DataFrame, stratum: str, unit: str, record: str, n: int, salt: str) -> DataFrame:
    """``n`` of the rows, or all if there are fewer: (stratum, unit, record).

    The strata share n evenly; what a small one can't give goes to the larger ones (a water level), and what is left over goes one by one to those that have more, in
    their order by name. A stratum gives one row for each unit first, in an order by hash, then other rows, in an order by hash. The first pass counts the strata;
    in the second no task holds more than n rows of a stratum. A record of a stratum that repeats counts once; rows without a stratum are one stratum."""
    own = rows.select(stratum, unit, record).distinct()
    key = lambda tag, c: h(f"{salt}-{tag}", F.col(stratum), F.col(c))
    first = own.groupBy(F.col(stratum).alias("_s"), F.col(unit).alias("_u")).agg(F.min(F.struct(key("one", record).alias("h"), F.col(record).alias("r")))["r"].alias("_one"))
    ranked = own.join(first, F.col(stratum).eqNullSafe(F.col("_s")) & F.col(unit).eqNullSafe(F.col("_u"))).select(stratum, unit, record, (F.col(record) != F.col("_one")).alias("_more"))
    order = (F.col("_more"), F.when(F.col("_more"), key("more", record)).otherwise(key("unit", unit)), F.col(unit), F.col(record))
    top = ranked.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_i") <= n)
    sizes = own.groupBy(stratum).agg(F.count("*").alias("_size"))
    # The highest level at which all strata together give no more than n.
    level = F.col("_level")
    given = sizes.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(n)))).groupBy("_level").agg(F.sum(F.least("_size", level)).alias("_sum"))
    best = given.where(F.col("_sum") <= n).agg(F.max(F.struct("_level", "_sum")).alias("b")).select("b.*", F.lit(0).alias("_all"))
    above = F.col("_size") > level
    # One row a stratum.
    w = Window.orderBy(F.when(above, 0).otherwise(1), stratum)
    quota = sizes.withColumn("_all", F.lit(0)).join(best, "_all").withColumn("_quota", F.least("_size", level) + F.when(above & (F.row_number().over(w) <= n - F.col("_sum")), 1).otherwise(0)).select(F.col(stratum).alias("_stratum"), "_quota")
    return top.join(quota, F.col(stratum).eqNullSafe(F.col("_stratum"))).where("_i <= _quota").select(stratum, unit, record)
