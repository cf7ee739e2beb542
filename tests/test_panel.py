"""Samples, rollouts and margins against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracegrain.operators import inference as inf
from tracegrain.operators import panel


def hashed(*x):
    return int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)


def filled(rows, n, salt):
    """Quotas one by one to the strata that have given least, by name among equals; units first."""
    strata = {}
    for s, u, r in sorted(set(rows)):
        strata.setdefault(s, {}).setdefault(u, []).append(r)
    queues = {}
    for s, units in strata.items():
        one = {u: min(own, key=lambda r: (hashed(f"{salt}-one", s, r), r)) for u, own in units.items()}
        queue = [(u, one[u]) for u in sorted(units, key=lambda u: (hashed(f"{salt}-unit", s, u), u))]
        queue += sorted(((u, r) for u, own in units.items() for r in own if r != one[u]), key=lambda x: (hashed(f"{salt}-more", s, x[1]), x))
        queues[s] = queue
    quota = dict.fromkeys(queues, 0)
    for _ in range(n):
        can = [s for s in quota if quota[s] < len(queues[s])]
        if not can:
            break
        quota[min(can, key=lambda s: (quota[s], s))] += 1
    return {(s, *x) for s, q in quota.items() for x in queues[s][:q]}


@pytest.mark.parametrize("n", [0, 1, 7, 50, 301, 10_000])
def test_filled_sample(spark, n):
    rng = random.Random(4)
    rows = [(s, f"u{rng.randrange(k)}", f"r{i}") for s, k, m in (("a", 3, 5), ("b", 40, 200), ("c", 1, 1), ("d", 10, 90), ("e", 500, 60)) for i in range(m)]
    got = panel.filled_sample(spark.createDataFrame(rows + rows[:20], "s string, u string, r string").repartition(5), "s", "u", "r", n, "x")
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) == min(n, len(rows)) and set(got) == filled(rows, n, "x")


def test_early_answering(spark):
    """The first rollout's fractions count; others of another length are dropped; missing answers agree with each other; empty rollouts have no curve."""
    rows = [("a", 2, 1.0, [0.5, 1.0], [1.0, 1.0]), ("a", 1, None, [0.25, 1.0], [None, 2.0]), ("a", 3, 1.0, [0.1, 0.2, 1.0], [1.0, 1.0, 1.0]), ("a", 4, 1.0, [9.0, 9.0], [None, 1.0]), ("b", 1, 1.0, [], []), ("b", 2, 1.0, [1.0], [1.0])]
    t = spark.createDataFrame(rows, "g string, at int, full double, fractions array<double>, truncated array<double>").repartition(3)
    got = {(r.g, r.position, r.fraction, r.n, round(r.at_answer, 9)) for r in panel.early_answering(t, "g", "at").collect()}
    assert got == {("a", 0, 0.25, 3, round(2 / 3, 9)), ("a", 1, 1.0, 3, round(2 / 3, 9))}
    assert panel.early_answering(t.limit(0), "g", "at").count() == 0


def test_margins(spark):
    """Two known candidates are needed, and a digit or a probability of its own; the order is kept."""
    tokens = [("a", -1.0, [-1.0, -3.0, None]), ("b", None, [-1.0, -2.0]), ("7", None, [-9.0, -1.0, -1.5]), ("c", -1.0, [-1.0, None]), ("x2y", -1.0, []), ("d", -0.5, [-4.0, -0.5])]
    kind = "t array<struct<token: string, logprob: double, top: array<double>>>"
    assert spark.createDataFrame([(tokens,), ([],)], kind).select(panel.margins("t").alias("m")).collect() == [([2.0, 0.5, 3.5],), ([],)]
    pairs = [([2.0, -2.0], [1.0, -2.0]), ([2.0, -2.0, 9.0], [1.0, -2.0]), ([], [1.0]), ([0.0], [1.0]), (None, [1.0])]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<double>, b array<double>").select(panel.attribution("a", "b")).collect()]
    assert got == [0.25, 0.25, None, None, None]


@pytest.mark.parametrize("width", [2, 3, 5])
def test_best_two_is_margins(spark, width):
    """Over flat arrays as over a trace's own: unknown candidates, ties, tokens that don't count, and no token at all."""
    rng = np.random.default_rng(width)
    traces = [[(rng.choice(["a", "7"]), [None, -1.0][rng.integers(2)], [None if rng.random() < 0.4 else -float(rng.integers(4)) for _ in range(width)]) for _ in range(k)] for k in (0, 1, 30, 3)]
    traces = [[(str(t), p, top) for t, p, top in trace] for trace in traces]
    kind = "t array<struct<token: string, logprob: double, top: array<double>>>"
    want = [r[0] for r in spark.createDataFrame([(t,) for t in traces], kind).select(panel.margins("t")).collect()]
    flat = [x for t in traces for x in t]
    top = np.array([[np.nan if v is None else v for v in x[2]] for x in flat])
    kept, m = panel.best_two(np.array([x[0] == "7" or x[1] is not None for x in flat]), top)
    assert m.tolist() == [x for own in want for x in own] and kept.sum() == len(m)


@pytest.mark.parametrize("name", ["p26_token_margins", "l05_token_attribution"])
def test_runs_stay_in_their_row(spark, name):
    """Both runs of a trace are made in its row: no record is shuffled to meet itself, and rows don't double before the margins."""
    from tracegrain.plans.queries import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "md5" not in plan


def test_binomial_draws(spark):
    """Inverse of the distribution function at the ends and between, and the mean of many."""
    import math

    ends = [(0, 20, 0.1), (2**32 - 1, 20, 0.1), (math.floor(2**32 * 0.9**20) - 1, 20, 0.1), (math.floor(2**32 * 0.9**20) + 1, 20, 0.1), (2**31, 80, 0.5), (2**31, 1, 0.4999)]
    t = spark.createDataFrame(ends, "u long, n int, p double")
    got = [r[0] for r in t.select(inf.binomial_draw(F.col("u"), F.col("n"), F.col("p"), 80)).collect()]
    assert got[0] == 0 and 10 < got[1] <= 20 and got[2:4] == [0, 1] and got[4] in (39, 40) and got[5] == 0
    many = spark.range(20_000).select(F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF)).alias("u"))
    mean = many.select(inf.binomial_draw(F.col("u"), F.lit(40), F.lit(0.2), 40).alias("c")).agg(F.avg("c"), F.var_pop("c")).first()
    assert abs(mean[0] - 8) < 0.1 and abs(mean[1] - 6.4) < 0.3


@pytest.mark.parametrize("n", [1, 3, 50])
def test_ranks_of_tied_scores(spark, n):
    """One score for two thirds of all rows: mid-ranks, and the partitions that hold it."""
    rng = np.random.default_rng(n)
    scores = [5.0 if i % 3 else float(rng.integers(0, 9)) for i in range(600)]
    got = {r.id: r.mid_rank for r in panel.mid_ranks(spark.createDataFrame(list(enumerate(scores)), "id int, s double").repartition(n), "s").collect()}
    assert got == {i: sum(x < s for x in scores) + (sum(x == s for x in scores) + 1) / 2 for i, s in enumerate(scores)}
