"""Bounds, sizes, rankings and tests against known values."""

import pytest
from pyspark.sql import functions as F

from tracegrain.functions.equality import eq_rel
from tracegrain.operators import inference as inf
from tracegrain.operators import ranking as rank
from tracegrain.operators.panel import roc_auc, spearman

#: Published sensitivities and bounds of six systems.
SIX = [("A", 0.388, 0.190), ("B", 0.202, 0.145), ("C", 0.188, 0.084), ("D", 0.086, 0.086), ("E", 0.003, 0.003), ("F", 0.000, 0.000)]


def test_upper_limits():
    assert inf.binomial_upper(2, 26) == pytest.approx(0.22289365499449815, abs=1e-12)
    assert inf.binomial_upper(2, 30) == pytest.approx(0.19532604365492595, abs=1e-12)
    assert inf.binomial_upper(0, 30) == pytest.approx(1 - 0.05 ** (1 / 30))
    assert inf.binomial_upper(5, 5) == inf.binomial_upper(0, 0) == 1
    assert 0.0101 < inf.binomial_upper(10_000, 1_000_000) < 0.0102
    assert inf.binomial_lower(99, 100, 0.025) == pytest.approx(0.9455, abs=1e-4)


def test_audit_sizes(spark):
    t = spark.createDataFrame([(g,) for g in (0.186, 0.102, 0.082, 0.043)], "g double")
    for alpha, want in ((0.05, [15, 28, 36, 69]), (0.05 / 6, [24, 45, 56, 109]), (0.05 / 12, [27, 51, 65, 125])):
        assert [r[0] for r in t.select(inf.audit_size(F.col("g"), F.lit(alpha))).collect()] == want


def test_rankings(spark):
    s = spark.createDataFrame(SIX, "model string, sigma double, m double")
    assert rank.forced(s).count() == 9
    assert rank.adjacent(s).where("determined").count() == 1
    assert rank.linear_extensions(s, 6).first().rankings == 20
    chain = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.5, 0.1), ("c", 0.1, 0.0)], s.schema)
    assert rank.linear_extensions(chain, 3).first().rankings == 1
    assert rank.linear_extensions(chain.withColumn("m", F.lit(1.0)), 3).first().rankings == 6


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r.k: r.holm_p for r in inf.holm(t, "p", ["k"]).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == got["c"] == pytest.approx(0.06) and got["d"] is None


def test_equality_is_total(spark):
    t = spark.createDataFrame([(None, None), (1.0, None), (None, 1.0), (1.0, 1.0 + 1e-10), (1.0, 1.1), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in t.select(eq_rel("a", "b")).collect()] == [True, False, False, True, False, False]


def test_ranks(spark):
    t = spark.createDataFrame([("m", float(s), y) for s, y in ((1, 0), (2, 0), (3, 1), (4, 1))] + [("t", 0.5, y) for y in (0, 1)] + [("one", 1.0, 1)], "k string, s double, y int")
    assert {r.k: r.auc for r in roc_auc(t, "k", "s", "y").collect()} == {"m": 1.0, "t": 0.5, "one": None}
    p = spark.createDataFrame([("k", 1.0, 3.0), ("k", 2.0, 2.0), ("k", 3.0, 1.0)], "k string, x double, y double")
    assert spearman(p, "k", "x", "y").first().rho == -1


def test_bootstrap_covers_planted_rate(spark):
    rows = spark.range(4000).select(F.lit("m").alias("model"), (F.col("id") % 100).alias("problem_id"), (F.xxhash64("id") % 10 == 0).cast("int").alias("hit"))
    c = inf.cluster_sums(rows, "model", "problem_id", {"hit": F.col("hit"), "n": F.lit(1)})
    lo, hi = inf.percentile_ci(F.col("hit") / F.col("n"))
    r = inf.resample(c, "model", "problem_id", ["hit", "n"], 200, "t").agg(lo.alias("lo"), hi.alias("hi")).first()
    true = rows.agg(F.avg("hit")).first()[0]
    assert r.lo < true < r.hi


def _number(salt, group, cluster, block, i):
    import hashlib

    return int(hashlib.md5(f"{salt}:{group}:{cluster}:{block}".encode()).hexdigest()[8 * i : 8 * i + 8], 16)


def _weight(salt, group, cluster, b):
    """A Poisson number with mean 1 by inverting its distribution."""
    import math

    u, k, total = _number(salt, group, cluster, b // 4, b % 4), 0, math.exp(-1)
    while u >= math.floor(2**32 * total) and k < 12:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


DRAWN = {"a": [3, -1, 4, 1], "b": [5, -9, 2], None: [7]}


def test_draws_against_brute_force(spark, monkeypatch):
    """A small number of draws, not a multiple of what a hash holds, draw by draw; groups and clusters in small portions."""
    for name, x in (("_GROUPS", 1), ("_CLUSTERS", 2)):
        monkeypatch.setattr(inf, name, x)
    draws, values = 130, {g: v for g, v in DRAWN.items() if g}
    c = spark.createDataFrame([(g, i, x) for g, v in values.items() for i, x in enumerate(v)], "g string, c int, v long")
    got = {(r.g, r.b): r.v for r in inf.resample(c, "g", "c", ["v"], draws, "s").collect()}
    assert got == {(g, b): sum(_weight("s", g, i, b) * x for i, x in enumerate(v)) for g, v in values.items() for b in range(draws)}
    sign = lambda g, i, b: -1 if _number("s", g, i, b // 128, b % 128 // 32) >> b % 32 & 1 else 1
    null = {g: [abs(sum(sign(g, i, b) * x for i, x in enumerate(v))) for b in range(draws)] for g, v in values.items()}
    want = {g: (1 + sum(x >= abs(sum(values[g])) for x in null[g])) / (draws + 1) for g in values}
    assert {r.g: r.p for r in inf.sign_flips(c, "g", "c", "v", draws, "s").collect()} == want


def test_any_statistic(spark):
    """Rows, not sums: a maximum, a weighted count, and a ratio that is no number in draws without a negative value."""
    draws, values = 50, {g: v for g, v in DRAWN.items() if g}
    rows = spark.createDataFrame([(g, i, x) for g, v in values.items() for i, x in enumerate(v)], "g string, c int, v long")
    ratio = lambda w: F.sum(F.when(F.col("v") > 0, w)).cast("double") / F.when(F.count_if(F.col("v") < 0) > 0, 1.0).otherwise(F.lit(float("inf")) - F.lit(float("inf")))
    got = {(r.g, r.b): (r.top, r.n, r.odd) for r in inf.bootstrap(rows, "g", "c", {"top": lambda w: F.max("v"), "n": lambda w: F.sum(w), "odd": ratio}, draws, "s").collect()}
    for g, v in values.items():
        for b in range(draws):
            w = [_weight("s", g, i, b) for i in range(len(v))]
            drawn = [x for x, k in zip(v, w, strict=True) if k]
            if drawn:
                plus = [k for x, k in zip(v, w, strict=True) if k and x > 0]
                assert got[g, b][:2] == (max(drawn), sum(w)) and got[g, b][2] == (sum(plus) if plus and min(drawn) < 0 else None)
            else:
                assert (g, b) not in got


def test_weights_have_mean_and_variance_one():
    import numpy as np

    w = np.concatenate([inf._poisson("s", 5000)("g", str(i)) for i in range(40)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() < 13


def test_resampling_has_the_reference_size(spark):
    from tracegrain.plans import inference_queries as q

    assert q.DRAWS == 10_000 and q.REPLICATES == 2_000
    # Fifteen pairs can come out significant after adjustment.
    p = [(f"{i}", 1 / (q.DRAWS + 1)) for i in range(15)]
    assert max(r.holm_p for r in inf.holm(spark.createDataFrame(p, "k string, p double"), "p", ["k"]).collect()) < 0.05


def test_audit_pool_is_not_sent_to_all_tasks(spark, monkeypatch):
    """The records meet the picks in a shuffle, however small their file is."""
    from conftest import SF

    from tracegrain.plans import inference_queries as iq

    written = []
    real = iq.materialise
    monkeypatch.setattr(iq, "materialise", lambda df, tag: written.append((tag, df._jdf.queryExecution().executedPlan().toString())) or real(df, tag))
    monkeypatch.setattr(iq, "REPLICATES", 20)
    assert iq.x14_certify(spark, SF).count() <= len(iq.BUDGETS)
    plan = dict(written)["audits"]
    assert "SortMergeJoin [model#" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "problem_id" in x]
