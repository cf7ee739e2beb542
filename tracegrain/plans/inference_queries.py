"""Intervals, tests, identified sets, pairwise comparisons and rankings of systems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracegrain.functions.equality import eq_lt, lt, rel
from tracegrain.functions.portable import h, h_sql
from tracegrain.functions.trace import pin
from tracegrain.operators import inference as inf
from tracegrain.operators import ranking as rank
from tracegrain.operators.gates import scored
from tracegrain.operators.panel import filled_sample
from tracegrain.operators.rates import RATES_SQL, counts_sql, outcome_counts, outcome_rates, share
from tracegrain.plans.rate_queries import gated, items
from tracegrain.plans.registry import query
from tracegrain.sources.scratch import materialise

#: The reference's size: no p-value falls below 1 / (DRAWS + 1).
DRAWS = 10_000


@query(
    f"""
WITH by_problem AS (SELECT model, problem_id, count(*) FILTER (WHERE outcome = 'F') AS f, count(*) FILTER (WHERE outcome = 'D') AS d, count(*) FILTER (WHERE changed) AS s, count(*) AS n FROM scored WHERE gated GROUP BY model, problem_id),
draws AS ({inf.resample_sql("by_problem", "model", "problem_id", ["f", "d", "s", "n"], DRAWS, "x01")}), point AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model)
SELECT d.model, any_value(p.phi) AS phi, any_value(p.delta) AS delta, any_value(p.sigma) AS sigma,
  {", ".join(f"round(quantile_cont(d.{c} / nullif(d.n, 0), {q}), 9) AS {name}_{side}" for c, name in (("f", "phi"), ("d", "delta"), ("s", "sigma")) for q, side in ((0.025, "lo"), (0.975, "hi")))}
FROM draws d JOIN point p ON p.model = d.model GROUP BY d.model
""",
    "scored",
)
def x01_bootstrap(spark, sf):
    """Percentile intervals of the three rates, resampling whole problems."""
    rows, o = gated(spark, sf), F.col("outcome")
    c = inf.cluster_sums(rows, "model", "problem_id", {"f": (o == "F").cast("int"), "d": (o == "D").cast("int"), "s": F.col("changed").cast("int"), "n": F.lit(1)})
    draws = inf.resample(c, "model", "problem_id", ["f", "d", "s", "n"], DRAWS, "x01")
    cis = {f"{name}_{side}": ci for x, name in (("f", "phi"), ("d", "delta"), ("s", "sigma")) for side, ci in zip(("lo", "hi"), inf.percentile_ci(F.try_divide(F.col(x), F.col("n"))), strict=True)}
    return draws.groupBy("model").agg(*(v.alias(k) for k, v in cis.items())).join(outcome_rates(rows, "model").select("model", "phi", "delta", "sigma"), "model").select("model", "phi", "delta", "sigma", *cis)


#: A statistic that is no function of sums keeps every draw's rows.
MEDIAN_DRAWS = 400


@query(
    f"""
WITH v AS (SELECT model, problem_id, trace_length AS v, count(*) AS n FROM scored WHERE gated GROUP BY ALL),
drawn AS (SELECT model, b, v, sum(n * w)::BIGINT AS f FROM ({inf.weights_sql("v", "model", "problem_id", MEDIAN_DRAWS, "median")}) WHERE w > 0 GROUP BY ALL),
cum AS (SELECT *, sum(f) OVER (PARTITION BY model, b ORDER BY v) AS upto, sum(f) OVER (PARTITION BY model, b) AS total FROM drawn),
med AS (SELECT model, b, (min(v) FILTER (WHERE upto > (total - 1) // 2) + min(v) FILTER (WHERE upto > total // 2)) / 2.0::DOUBLE AS m FROM cum GROUP BY model, b),
share AS (SELECT model, b, sum(f) FILTER (WHERE v >= 4)::DOUBLE / nullif(sum(f) FILTER (WHERE v < 4), 0) AS odds FROM drawn GROUP BY model, b)
SELECT med.model, count(*) AS draws, round(quantile_cont(m, 0.025), 9) AS median_lo, round(quantile_cont(m, 0.975), 9) AS median_hi, round(quantile_cont(odds, 0.025), 9) AS odds_lo, round(quantile_cont(odds, 0.975), 9) AS odds_hi
FROM med JOIN share USING (model, b) GROUP BY med.model
""",
    "scored",
)
def x01_any_statistic(spark, sf):
    """Percentile intervals of a median and of odds of the traces' lengths, resampling whole problems; odds without a short trace are left out."""
    alike = gated(spark, sf).groupBy("model", "problem_id", F.col("trace_length").alias("v")).agg(F.count("*").alias("n"))
    n_of = lambda w, c: F.sum(F.when(c, w * F.col("n")))
    draws = inf.bootstrap(alike, "model", "problem_id", {"m": lambda w: F.percentile("v", 0.5, w * F.col("n")), "odds": lambda w: F.try_divide(n_of(w, F.col("v") >= 4), n_of(w, F.col("v") < 4))}, MEDIAN_DRAWS, "median")
    cis = {f"{name}_{side}": ci for x, name in (("m", "median"), ("odds", "odds")) for side, ci in zip(("lo", "hi"), inf.percentile_ci(F.col(x)), strict=True)}
    return draws.groupBy("model").agg(F.count("*").alias("draws"), *(v.alias(k) for k, v in cis.items()))


def paired(rows):
    """Items that two systems share: (hi, lo, problem_id, record_id, d1, d2), systems in the order of their names."""
    one = rows.select("model", "record_id", "problem_id", (F.col("outcome") == "D").cast("int").alias("d"))
    a = one.select(F.col("model").alias("a"), "record_id", "problem_id", F.col("d").alias("d1"))
    b = one.select(F.col("model").alias("b"), "record_id", F.col("d").alias("d2"))
    return a.join(b, "record_id").where("a < b")


PAIRED = "SELECT x.model AS a, y.model AS b, x.problem_id, x.record_id, (x.outcome = 'D')::INT AS d1, (y.outcome = 'D')::INT AS d2 FROM scored x JOIN scored y ON x.record_id = y.record_id AND x.model < y.model WHERE x.recount AND y.recount"


@query(
    f"""WITH paired AS ({PAIRED}), t AS (SELECT a, b, count(*) AS n, sum((d1 <> d2)::INT)::BIGINT AS n_disc, sum(d1)::DOUBLE / count(*) AS delta1, sum(d2)::DOUBLE / count(*) AS delta2 FROM paired GROUP BY a, b)
SELECT a, b, n, n_disc, delta1, delta2, round(delta1 + delta2 - 2 * delta1 * delta2, 9) AS predicted, round(delta1 + delta2 - 2 * delta1 * delta2 - n_disc::DOUBLE / n, 9) AS excess FROM t""",
    "scored",
)
def a28_discordance(spark, sf):
    t = paired(scored(items(spark, sf)).where("recount")).groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum((F.col("d1") != F.col("d2")).cast("int")).alias("n_disc"), (F.sum("d1") / F.count("*")).alias("delta1"), (F.sum("d2") / F.count("*")).alias("delta2")
    )
    predicted = F.col("delta1") + F.col("delta2") - 2 * F.col("delta1") * F.col("delta2")
    return t.select("a", "b", "n", "n_disc", "delta1", "delta2", F.round(predicted, 9).alias("predicted"), F.round(predicted - F.col("n_disc") / F.col("n"), 9).alias("excess"))


@query(
    f"""
WITH paired AS ({PAIRED}), by_problem AS (SELECT concat(a, '|', b) AS pair, problem_id, sum(d1) AS d1, sum(d2) AS d2, sum((d1 <> d2)::INT) AS x, count(*) AS n FROM paired GROUP BY a, b, problem_id),
draws AS ({inf.resample_sql("by_problem", "pair", "problem_id", ["d1", "d2", "x", "n"], DRAWS, "x02")}),
e AS (SELECT pair, round(d1 / n + d2 / n - 2 * (d1 / n) * (d2 / n) - x / n, 9) AS excess FROM draws),
r AS (SELECT pair, excess, row_number() OVER (PARTITION BY pair ORDER BY excess) - 1 AS i FROM e)
SELECT pair, max(excess) FILTER (WHERE i = {int(0.025 * DRAWS)}) AS lo, max(excess) FILTER (WHERE i = {int(0.975 * DRAWS)}) AS hi,
  NOT (max(excess) FILTER (WHERE i = {int(0.025 * DRAWS)}) <= 0 AND max(excess) FILTER (WHERE i = {int(0.975 * DRAWS)}) >= 0) AS significant FROM r GROUP BY pair
""",
    "scored",
)
def x02_excess_bootstrap(spark, sf):
    """Interval of the excess over independence, by order statistics."""
    t = paired(scored(items(spark, sf)).where("recount")).withColumn("pair", F.concat_ws("|", "a", "b"))
    c = inf.cluster_sums(t, "pair", "problem_id", {"d1": F.col("d1"), "d2": F.col("d2"), "x": (F.col("d1") != F.col("d2")).cast("int"), "n": F.lit(1)})
    draws = inf.resample(c, "pair", "problem_id", ["d1", "d2", "x", "n"], DRAWS, "x02")
    p, q = F.col("d1") / F.col("n"), F.col("d2") / F.col("n")
    sorted_ = draws.groupBy("pair").agg(F.sort_array(F.collect_list(F.round(p + q - 2 * p * q - F.col("x") / F.col("n"), 9))).alias("e"))
    lo, hi = F.col("e")[int(0.025 * DRAWS)], F.col("e")[int(0.975 * DRAWS)]
    return sorted_.select("pair", lo.alias("lo"), hi.alias("hi"), (~((lo <= 0) & (hi >= 0))).alias("significant"))


@query(
    f"""
WITH by_problem AS (SELECT model, problem_id, sum({lt("ans_copyable", "den_copyable")}::INT - {lt("ans_treat", "den_treat")}::INT) AS v FROM items
  WHERE status = 'built' AND ans_copyable IS NOT NULL AND den_copyable IS NOT NULL AND ans_treat IS NOT NULL AND den_treat IS NOT NULL GROUP BY model, problem_id)
{inf.sign_flips_sql("by_problem", "model", "problem_id", "v", DRAWS, "x03")}
""",
    "items",
)
def x03_permutation(spark, sf):
    """Sign-flip test of the copy control, problems flipped as a whole."""
    from tracegrain.functions.equality import eq_lt

    rows = items(spark, sf).where("status = 'built'").dropna(subset=["ans_copyable", "den_copyable", "ans_treat", "den_treat"])
    c = inf.cluster_sums(rows, "model", "problem_id", {"v": eq_lt("ans_copyable", "den_copyable").cast("int") - eq_lt("ans_treat", "den_treat").cast("int")})
    return inf.sign_flips(c, "model", "problem_id", "v", DRAWS, "x03")


@query(f"SELECT model, d AS delta_bar, round(sigma - least(sigma, d), 9) AS lo, sigma AS hi FROM (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model), (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) v(d)", "scored")
def x04_identified_set(spark, sf):
    t = outcome_rates(gated(spark, sf), "model").select("model", "sigma", F.explode(F.array(*map(F.lit, (0.05, 0.1, 1.0)))).alias("delta_bar"))
    return t.select("model", "delta_bar", F.round(F.col("sigma") - F.least("sigma", "delta_bar"), 9).alias("lo"), F.col("sigma").alias("hi"))


@query(
    f"""WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model)
SELECT a.model AS hi_model, b.model AS lo_model, round(a.sigma - b.sigma - least(a.sigma, 0.1), 9) AS lo, round(a.sigma - b.sigma + least(b.sigma, 0.1), 9) AS hi, a.sigma - b.sigma > least(a.sigma, 0.1) AS determined
FROM r a JOIN r b ON a.sigma > b.sigma""",
    "scored",
)
def x05_pair_identified_set(spark, sf):
    r = outcome_rates(gated(spark, sf), "model").select("model", "sigma")
    a, b = r.select(F.col("model").alias("hi_model"), F.col("sigma").alias("s1")), r.select(F.col("model").alias("lo_model"), F.col("sigma").alias("s2"))
    m1, m2, s = F.least("s1", F.lit(0.1)), F.least("s2", F.lit(0.1)), F.col("s1") - F.col("s2")
    return a.join(b, F.col("s1") > F.col("s2")).select("hi_model", "lo_model", F.round(s - m1, 9).alias("lo"), F.round(s + m2, 9).alias("hi"), (s > m1).alias("determined"))


@query(
    f"""WITH counts AS ({counts_sql("worst")}), t AS ({rank.BOUNDED_SQL[True]}), pairs AS (SELECT c, n_eff AS n FROM t), {inf.upper_sql("pairs")}
SELECT t.model, t.c, t.n_eff, round(b.up, 6) AS up, round(least(t.sigma, b.up), 6) AS m FROM t JOIN bound b ON b.c = t.c AND b.n = t.n_eff""",
    "scored",
)
def x06_upper_limit(spark, sf):
    """Exact upper limits of derailment, for counts scaled by the design effect."""
    t = rank.bounded(outcome_counts(scored(items(spark, sf)).where("recount"), "model"), corrected=True)
    return t.select("model", F.col("c_eff").alias("c"), "n_eff", F.round(inf.upper("c_eff", "n_eff"), 6).alias("up"), F.round("m", 6).alias("m"))


@query(
    f"""WITH counts AS ({counts_sql("worst")}), pairs AS (SELECT derail AS c, n FROM counts UNION SELECT n - derail AS c, n FROM counts), {inf.upper_sql("pairs", "0.025")}
SELECT model, derail, counts.n AS n, round(1 - l.up, 6) AS lo, round(u.up, 6) AS hi FROM counts JOIN bound l ON l.c = counts.n - derail AND l.n = counts.n JOIN bound u ON u.c = derail AND u.n = counts.n""",
    "scored",
)
def x07_two_sided(spark, sf):
    """Exact two-sided intervals of derailment, half of the error on each side."""
    t = outcome_counts(scored(items(spark, sf)).where("recount"), "model")
    return t.select("model", "derail", "n", F.round(inf.lower("derail", "n", 0.025), 6).alias("lo"), F.round(inf.upper("derail", "n", 0.025), 6).alias("hi"))


def gaps(spark, sf):
    """Each system's lead over the next; no audit can certify a lead of nothing."""
    r = outcome_rates(gated(spark, sf), "model").select("model", "sigma")
    w = Window.orderBy(F.col("sigma").desc(), "model")
    return r.select("model", (F.col("sigma") - F.lead("sigma").over(w)).alias("g")).where("g > 0")


GAPS = f"SELECT * FROM (SELECT model, sigma - lead(sigma) OVER (ORDER BY sigma DESC, model) AS g FROM (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model)) WHERE g > 0"


@query(f"""WITH gaps AS ({GAPS}) SELECT model, round(g, 9) AS g, a.alpha, {inf.audit_size_sql("g", "a.alpha")} AS audit_n FROM gaps, (VALUES (0.05::DOUBLE), (0.01::DOUBLE)) a(alpha)""", "scored")
def x08_audit_size(spark, sf):
    t = gaps(spark, sf).withColumn("alpha", F.explode(F.array(F.lit(0.05), F.lit(0.01))))
    return t.select("model", F.round("g", 9).alias("g"), "alpha", inf.audit_size(F.col("g"), F.col("alpha")).alias("audit_n"))


@query(
    f"""WITH gaps AS ({GAPS}), t AS (SELECT model, g, {inf.audit_size_sql("g", "0.05::DOUBLE")} AS n FROM gaps)
SELECT model, n, ceil(3 / g)::BIGINT AS rule_of_three, ceil((3 + ln(6)) / g)::BIGINT AS six_systems, ceil(ln(6 / 0.05::DOUBLE) / g)::BIGINT AS union_bound, n <= ceil(3 / g) AS dominated FROM t""",
    "scored",
)
def x09_envelope(spark, sf):
    g = F.col("g")
    t = gaps(spark, sf).withColumn("n", inf.audit_size(g, F.lit(0.05)))
    up = lambda x: F.ceil(x / g).cast("bigint")
    return t.select("model", "n", up(F.lit(3)).alias("rule_of_three"), up(3 + F.log(F.lit(6.0))).alias("six_systems"), up(F.log(F.lit(6.0) / 0.05)).alias("union_bound"), (F.col("n") <= F.ceil(3 / g)).alias("dominated"))


@query(
    f"""WITH counts AS ({counts_sql("worst")}) SELECT model, round(n::DOUBLE / nprob, 9) AS deff, greatest(0, round_even(derail / (n::DOUBLE / nprob), 0))::BIGINT AS c_eff, greatest(1, round_even(n / (n::DOUBLE / nprob), 0))::BIGINT AS n_eff,
  round(greatest(0, 1 - (SELECT count(*) FROM counts) * 0.05::DOUBLE), 9) AS joint_coverage FROM counts""",
    "scored",
)
def x10_design_effect(spark, sf):
    """With the union bound on the coverage of all systems' intervals at once (x11)."""
    t = rank.bounded(outcome_counts(scored(items(spark, sf)).where("recount"), "model"), corrected=True)
    k = F.count("*").over(Window.partitionBy(F.lit(1)))
    return t.select("model", F.round(F.col("n") / F.col("nprob"), 9).alias("deff"), "c_eff", "n_eff", F.round(F.greatest(F.lit(0.0), 1 - k * 0.05), 9).alias("joint_coverage"))


@query(
    f"""
WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model),
by_problem AS (SELECT model, problem_id, count(*) FILTER (WHERE outcome = 'D') AS d, count(*) AS n FROM scored WHERE gated GROUP BY model, problem_id),
draws AS ({inf.resample_sql("by_problem", "model", "problem_id", ["d", "n"], DRAWS, "x13")}), bar AS (SELECT model, round(quantile_cont(d / nullif(n, 0), 0.975), 9) AS delta_bar FROM draws GROUP BY model),
f AS (SELECT model, problem_id, count(*) FILTER (WHERE {lt("ans_treat", "den_treat")})::DOUBLE / count(*) AS follow FROM scored WHERE gated AND ans_treat IS NOT NULL GROUP BY model, problem_id),
pairs AS (SELECT a.model AS hi, b.model AS lo, a.sigma - b.sigma AS margin, abs(a.delta - b.delta) AS spread, greatest(x.delta_bar, y.delta_bar) AS dbar, a.sigma - b.sigma > least(a.sigma, greatest(x.delta_bar, y.delta_bar)) AS determined, concat(a.model, '|', b.model) AS pair
  FROM r a JOIN r b ON a.sigma > b.sigma JOIN bar x ON x.model = a.model JOIN bar y ON y.model = b.model),
d AS (SELECT p.pair, f1.problem_id, f1.follow - f2.follow AS v FROM pairs p JOIN f f1 ON f1.model = p.hi JOIN f f2 ON f2.model = p.lo AND f2.problem_id = f1.problem_id),
test AS ({inf.sign_flips_sql("d", "pair", "problem_id", "v", DRAWS, "x13")}), diff AS (SELECT pair, count(*) AS paired_n, round(avg(v), 9) AS phi_difference FROM d GROUP BY pair),
h AS (SELECT t.pair, t.p, max((m - k + 1) * p) OVER (ORDER BY k) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p, pair) AS k, count(*) OVER () AS m FROM test) t)
SELECT p.hi, p.lo, round(margin, 9) AS margin, round(spread, 9) AS spread, dbar, determined, paired_n, phi_difference, round(p, 9) AS p, round(least(1, adj), 9) AS holm_p FROM pairs p JOIN diff USING (pair) JOIN h USING (pair)
""",
    "scored",
)
def x13_pairwise(spark, sf):
    """Each pair of systems: is its order by sensitivity determined, and do the follow rates differ, problem by problem?"""
    o, said = F.col("outcome"), F.col("ans_treat").isNotNull()
    one = lambda c: c.cast("int")
    sums = {"d": one(o == "D"), "s": one(F.col("changed")), "n": F.lit(1), "hit": one(said & eq_lt("ans_treat", "den_treat")), "said": one(said)}
    # One row for each system and problem, from which all else follows.
    c = materialise(inf.cluster_sums(gated(spark, sf), "model", "problem_id", sums), "pairwise-sums")
    bar = inf.resample(c, "model", "problem_id", ["d", "n"], DRAWS, "x13").groupBy("model").agg(inf.percentile_ci(F.try_divide("d", "n"))[1].alias("bar"))
    r = c.groupBy("model").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("sigma"), F.try_divide(F.sum("d"), F.sum("n")).alias("delta")).join(bar, "model")
    r = rank.held(r)
    side = lambda name, i: r.select(F.col("model").alias(name), *(F.col(x).alias(f"{x}{i}") for x in ("sigma", "delta", "bar")))
    pairs = side("hi", 1).join(side("lo", 2), F.col("sigma1") > F.col("sigma2"))
    margin, dbar = F.col("sigma1") - F.col("sigma2"), F.greatest("bar1", "bar2")
    pairs = pairs.select("hi", "lo", F.round(margin, 9).alias("margin"), F.round(F.abs(F.col("delta1") - F.col("delta2")), 9).alias("spread"), dbar.alias("dbar"), (margin > F.least("sigma1", dbar)).alias("determined"), F.concat_ws("|", "hi", "lo").alias("pair"))
    f = c.where("said > 0").select("model", "problem_id", (F.col("hit") / F.col("said")).alias("follow"))
    d = f.select(F.col("model").alias("hi"), "problem_id", F.col("follow").alias("f1")).join(f.select(F.col("model").alias("lo"), "problem_id", F.col("follow").alias("f2")), "problem_id").where("hi <> lo")
    d = d.join(pairs.select("hi", "lo", "pair"), ["hi", "lo"]).select("pair", "problem_id", (F.col("f1") - F.col("f2")).alias("v"))
    test = inf.sign_flips(d, "pair", "problem_id", "v", DRAWS, "x13")
    test = inf.holm(test, "p", ["pair"])
    diff = d.groupBy("pair").agg(F.count("*").alias("paired_n"), F.round(F.avg("v"), 9).alias("phi_difference"))
    return pairs.join(diff, "pair").join(test, "pair").select("hi", "lo", "margin", "spread", "dbar", "determined", "paired_n", "phi_difference", F.round("p", 9).alias("p"), F.round("holm_p", 9).alias("holm_p"))


@query(
    f"""WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model) SELECT round(avg((NOT (a.sigma - b.sigma > least(a.sigma, 0.1)))::INT), 9) AS fraction_underdetermined, count(*) AS n_pairs FROM r a JOIN r b ON a.sigma > b.sigma""",
    "scored",
)
def a24_underdetermined(spark, sf):
    return x05_pair_identified_set(spark, sf).agg(F.round(F.avg((~F.col("determined")).cast("int")), 9).alias("fraction_underdetermined"), F.count("*").alias("n_pairs"))


BUDGETS, REPLICATES = [10, 20, 30, 50, 100], 2_000


@query(
    f"""
WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE recount GROUP BY model),
pairs AS (SELECT a.model AS hi, b.model AS lo, a.sigma AS s, a.sigma - b.sigma AS g, a.phi <= b.phi AS wrong FROM r a JOIN r b ON a.sigma > b.sigma),
pool AS (SELECT model, problem_id, (outcome = 'D')::INT AS d, row_number() OVER (PARTITION BY model, problem_id ORDER BY record_id) - 1 AS i, count(*) OVER (PARTITION BY model, problem_id) AS k FROM scored WHERE recount),
prob AS (SELECT DISTINCT model, problem_id, k FROM pool), np AS (SELECT model, count(*) AS n_prob FROM prob GROUP BY model),
pick AS (SELECT hi, lo, rep, problem_id, {h_sql("'item'", "hi", "lo", "rep", "problem_id")} % k AS i, row_number() OVER (PARTITION BY hi, lo, rep ORDER BY {h_sql("'prob'", "hi", "lo", "rep", "problem_id")}, problem_id) AS rk
  FROM pairs p JOIN prob ON prob.model = p.hi, range(0, {REPLICATES}) t(rep)),
seen AS (SELECT hi, lo, rep, budget AS n, sum(d)::BIGINT AS c FROM pick JOIN pool ON pool.model = hi AND pool.problem_id = pick.problem_id AND pool.i = pick.i JOIN np ON np.model = hi, (VALUES {", ".join(f"({b})" for b in BUDGETS)}) v(budget) WHERE rk <= budget AND n_prob >= budget GROUP BY hi, lo, rep, budget),
{inf.upper_sql("seen")}
SELECT seen.n AS budget, count(*) AS trials, count(*) FILTER (WHERE g > least(s, up)) AS certified, count(*) FILTER (WHERE g > least(s, up) AND wrong) AS mis_certified
FROM seen JOIN pairs ON pairs.hi = seen.hi AND pairs.lo = seen.lo JOIN bound ON bound.c = seen.c AND bound.n = seen.n GROUP BY seen.n
""",
    "scored",
)
def x14_certify(spark, sf):
    """How often audits of a few problems certify an order of two systems, and how often wrongly.

    Limits are computed once for each (derailed, budget), not for each audit."""
    rows = scored(items(spark, sf)).where("recount").select("model", "problem_id", "record_id", "outcome", "changed")
    rows = materialise(rows, "audit-pool")
    r = rank.held(outcome_rates(rows, "model").select("model", "sigma", "phi"))
    a, b = (r.select(F.col("model").alias(m), F.col("sigma").alias(f"s{m}"), F.col("phi").alias(f"p{m}")) for m in ("hi", "lo"))
    pairs = a.join(b, F.col("shi") > F.col("slo")).select("hi", "lo", F.col("shi").alias("s"), (F.col("shi") - F.col("slo")).alias("g"), (F.col("phi") <= F.col("plo")).alias("wrong"))
    w = Window.partitionBy("model", "problem_id")
    pool = rows.select("model", "problem_id", (F.col("outcome") == "D").cast("int").alias("d"), (F.row_number().over(w.orderBy("record_id")) - 1).alias("i"), F.count("*").over(w).alias("k"))
    prob = pool.where("i = 0").select("model", "problem_id", "k", F.count("*").over(Window.partitionBy("model")).alias("n_prob"))
    trial = inf.each_draw(pairs.select("hi", "lo").join(prob, F.col("hi") == F.col("model")), REPLICATES, "rep", "hi", "lo")
    key = [F.col(x) for x in ("hi", "lo", "rep", "problem_id")]
    order = Window.partitionBy("hi", "lo", "rep").orderBy(h("prob", *key), "problem_id")
    pick = trial.select("hi", "lo", "rep", "model", "problem_id", "n_prob", (h("item", *key) % F.col("k")).cast("int").alias("i"), F.row_number().over(order).alias("rk"))
    # The pool grows with the records: compressed it looks small enough to be sent to all tasks through the driver, which it isn't.
    drawn = pick.where(F.col("rk") <= max(BUDGETS)).join(pool.select("model", "problem_id", "i", "d").hint("merge"), ["model", "problem_id", "i"])
    drawn = drawn.withColumn("n", F.explode(F.array(*map(F.lit, BUDGETS)))).where("rk <= n and n_prob >= n")
    seen = materialise(drawn.groupBy("hi", "lo", "rep", "n").agg(F.sum("d").alias("c")), "audits")
    limits = F.broadcast(seen.select("c", "n").distinct().withColumn("up", inf.upper("c", "n")))
    ok = F.col("g") > F.least("s", "up")
    return seen.join(limits, ["c", "n"]).join(pairs, ["hi", "lo"]).groupBy(F.col("n").alias("budget")).agg(F.count("*").alias("trials"), F.count(F.when(ok, 1)).alias("certified"), F.count(F.when(ok & F.col("wrong"), 1)).alias("mis_certified"))


@query(
    f"""WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model), t AS (SELECT * FROM r ORDER BY sigma, model LIMIT 1)
SELECT t.model, d AS added_delta, round(t.phi + d, 9) AS sigma, (1 + (SELECT count(*) FROM r WHERE r.model <> t.model AND r.sigma > t.phi + d)) AS sigma_rank, (1 + (SELECT count(*) FROM r WHERE r.model <> t.model AND r.phi > t.phi)) AS phi_rank,
  {inf.audit_size_sql("d", "0.05::DOUBLE")} AS audit_n, round(((SELECT max(sigma) FROM r) - t.phi - t.delta) / t.psi, 9) AS share_to_top
FROM t, (VALUES (0.024::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(d)""",
    "scored",
)
def x15_evasion(spark, sf):
    """What the least sensitive system's rank becomes if it trades stability for derailment; and the audit that shows it."""
    r = outcome_rates(gated(spark, sf), "model")
    t = r.orderBy("sigma", "model").limit(1).withColumn("d", F.explode(F.array(*map(F.lit, (0.024, 0.1, 0.15, 0.2, 0.3)))))
    other = r.select(F.col("model").alias("other"), F.col("sigma").alias("so"), F.col("phi").alias("po"))
    j = t.join(other, F.lit(True))
    above = lambda c: 1 + F.count(F.when((F.col("other") != F.col("model")) & c, 1))
    s = F.col("phi") + F.col("d")
    out = j.groupBy("model", "d", "phi", "psi", "delta").agg(above(F.col("so") > s).alias("sigma_rank"), above(F.col("po") > F.col("phi")).alias("phi_rank"), F.max("so").alias("top"))
    return out.select("model", F.col("d").alias("added_delta"), F.round(s, 9).alias("sigma"), "sigma_rank", "phi_rank", inf.audit_size(F.col("d"), F.lit(0.05)).alias("audit_n"), F.round((F.col("top") - F.col("phi") - F.col("delta")) / F.col("psi"), 9).alias("share_to_top"))


@query(
    f"""
WITH counts AS ({counts_sql("worst")}), t AS ({rank.BOUNDED_SQL[True]}), paired AS ({PAIRED}), disc AS (SELECT a, b, sum((d1 <> d2)::INT)::BIGINT AS c, count(*) AS n FROM paired GROUP BY a, b),
pairs AS (SELECT c, n_eff AS n FROM t UNION SELECT c, n FROM disc), {inf.upper_sql("pairs")},
m AS (SELECT t.model, t.sigma, least(t.sigma, b.up) AS m FROM t JOIN bound b ON b.c = t.c AND b.n = t.n_eff),
g AS (SELECT abs(x.sigma - y.sigma) AS g, CASE WHEN x.sigma >= y.sigma THEN x.m ELSE y.m END AS m1, b.up AS dbar FROM disc JOIN m x ON x.model = disc.a JOIN m y ON y.model = disc.b JOIN bound b ON b.c = disc.c AND b.n = disc.n)
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE g > m1) AS unpaired, count(*) FILTER (WHERE g > dbar) AS paired, count(*) FILTER (WHERE g > least(m1, dbar)) AS either FROM g
""",
    "scored",
)
def x16_certified_counts(spark, sf):
    """Pairs certified by the higher system's own limit, by the paired discordance limit, and by the better of both."""
    rows = scored(items(spark, sf)).where("recount")
    m = rank.bounded(outcome_counts(rows, "model"), corrected=True).select("model", "sigma", "m")
    disc = paired(rows).groupBy("a", "b").agg(F.sum((F.col("d1") != F.col("d2")).cast("int")).alias("c"), F.count("*").alias("n")).withColumn("dbar", inf.upper("c", "n"))
    side = lambda name: m.select(F.col("model").alias(name), F.col("sigma").alias(f"s_{name}"), F.col("m").alias(f"m_{name}"))
    g = disc.join(side("a"), "a").join(side("b"), "b").select(F.abs(F.col("s_a") - F.col("s_b")).alias("g"), F.when(F.col("s_a") >= F.col("s_b"), F.col("m_a")).otherwise(F.col("m_b")).alias("m1"), "dbar")
    n_of = lambda x: F.count(F.when(F.col("g") > x, 1))
    return g.agg(F.count("*").alias("n_pairs"), n_of(F.col("m1")).alias("unpaired"), n_of(F.col("dbar")).alias("paired"), n_of(F.least("m1", "dbar")).alias("either"))


@query(
    """WITH g AS (SELECT l_linenumber AS s1, l_linenumber % 4 AS s2, CAST(l_quantity AS INT) % 8 AS d, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT count(*) AS n_cells, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE (s1 - s2 > least(s1, d)) <> (SELECT min(s1 - x - (s2 - y)) > 0 FROM range(0, 9) a(x), range(0, 9) b(y) WHERE x <= least(s1, d) AND y <= least(s2, d))) AS mismatches FROM g WHERE s1 > s2""",
)
def x17_pair_proposition(spark, sf):
    """On whole-number grids: a pair is determined exactly if no derailments within the bound reverse it."""
    from tracegrain.sources.fixtures import table

    g = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("s1"), (F.col("l_linenumber") % 4).alias("s2"), (F.col("l_quantity").cast("int") % 8).alias("d")).groupBy("s1", "s2", "d").agg(F.count("*").alias("n")).where("s1 > s2")
    steps = lambda s: F.sequence(F.lit(0), F.least(s, "d").cast("int"))
    worst = F.array_min(F.flatten(F.transform(steps("s1"), lambda x: F.transform(steps("s2"), lambda y: F.col("s1") - x - (F.col("s2") - y)))))
    return g.agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_rows"), F.count(F.when((F.col("s1") - F.col("s2") > F.least("s1", "d")) != (worst > 0), 1)).alias("mismatches"))


#: Audit sizes that the soundness check draws for.
AUDITS = [20, 40, 80]


@query(
    f"""WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model),
cdf AS (SELECT model, delta, sigma, n_audit AS n, c, sum(exp(lgamma(n_audit + 1) - CASE WHEN c = 0 THEN 0 ELSE lgamma(c + 1) END - lgamma(n_audit - c + 1) + c * ln(delta) + (n_audit - c) * ln(1 - delta))) OVER (PARTITION BY model, n_audit ORDER BY c) AS upto
  FROM r, (VALUES {", ".join(f"({n})" for n in AUDITS)}) a(n_audit), range(0, {max(AUDITS)} + 1) k(c) WHERE c <= n_audit AND delta > 0 AND delta < 1),
step AS (SELECT model, n, list(floor(upto * 4294967296)::BIGINT ORDER BY c) AS steps FROM cdf GROUP BY model, n),
trial AS (SELECT s.model, s.n, len(list_filter(steps[1:s.n], lambda t: {h_sql("'sound'", "i.model", "i.record_id", "s.n")} >= t))::BIGINT AS c FROM items i JOIN step s ON s.model = i.model),
pairs AS (SELECT DISTINCT c, n FROM trial), {inf.upper_sql("pairs")}
SELECT t.model, t.n::INT AS n_audit, count(*) AS trials, sum(t.c)::BIGINT AS derailed, count(*) FILTER (WHERE r.delta > least(r.sigma, round(b.up, 12))) AS wrong FROM trial t JOIN bound b ON b.c = t.c AND b.n = t.n JOIN r ON r.model = t.model GROUP BY t.model, t.n""",
    "scored",
)
def x17_soundness(spark, sf):
    """How often an audit accepts an order that doesn't hold: a rival that leads by exactly what derails, audits of three sizes, one trial for each item.

    The number derailed is drawn by inverting the binomial distribution at a hashed uniform; limits are worked out once for each (derailed, size)."""
    r = outcome_rates(gated(spark, sf), "model").where("delta > 0 and delta < 1").select("model", "sigma", "delta")
    cells = rank.held(r).withColumn("n", F.explode(F.array(*map(F.lit, AUDITS))))
    trial = items(spark, sf).select("model", "record_id").join(cells, "model")
    drawn = trial.select("model", "n", "delta", "sigma", inf.binomial_draw(h("sound", F.col("model"), F.col("record_id"), F.col("n")), F.col("n"), F.col("delta"), max(AUDITS)).alias("c"))
    # Counts alike are one row from here on.
    alike = drawn.groupBy("model", "n", "delta", "sigma", "c").agg(F.count("*").alias("k"))
    wrong = F.col("delta") > F.least("sigma", F.round(inf.upper("c", "n"), 12))
    return alike.withColumn("wrong", wrong).groupBy("model", F.col("n").alias("n_audit")).agg(F.sum("k").alias("trials"), F.sum(F.col("k") * F.col("c")).alias("derailed"), F.sum(F.when(F.col("wrong"), F.col("k")).otherwise(0)).alias("wrong"))


_BITS = "(1::BIGINT << n) - 1"


@query(
    f"""WITH t AS (SELECT 1 + {h_sql("'jensen n'", "l_orderkey", "l_linenumber", "l_partkey")} % 12 AS n, {h_sql("'jensen'", "l_orderkey", "l_linenumber", "l_partkey")} AS v FROM lineitem),
d AS (SELECT n, v & ({_BITS}) AS d1, (v >> 12) & ({_BITS}) AS d2 FROM t), g AS (SELECT n, abs(bit_count(d1)::INT - bit_count(d2)::INT) AS gap, bit_count(xor(d1, d2))::INT AS differ FROM d)
SELECT n::INT AS n_items, count(*) AS trials, sum(gap)::BIGINT AS gaps, sum(differ)::BIGINT AS differences, count(*) FILTER (WHERE gap = differ) AS tight, count(*) FILTER (WHERE gap > differ) AS violations FROM g GROUP BY n"""
)
def x17_paired_jensen(spark, sf):
    """Two systems on the same one to twelve items, one trial for each line item: their rates differ by no more than the share of items on which they do.

    Outcomes are bits of a hashed number, so that a trial is two bit counts."""
    from tracegrain.sources.fixtures import table

    key = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    t = table(spark, sf, "lineitem").select((1 + h("jensen n", *key) % 12).cast("int").alias("n"), h("jensen", *key).alias("v"))
    own = lambda v: v.bitwiseAND(F.expr("shiftleft(1L, n) - 1"))
    t = pin(t, d1=own(F.col("v")), d2=own(F.shiftright("v", 12)))
    g = pin(t, gap=F.abs(F.bit_count("d1") - F.bit_count("d2")), differ=F.bit_count(F.col("d1").bitwiseXOR(F.col("d2"))))
    n_of = lambda c: F.count(F.when(c, 1))
    return g.groupBy(F.col("n").alias("n_items")).agg(F.count("*").alias("trials"), F.sum("gap").alias("gaps"), F.sum("differ").alias("differences"), n_of(F.col("gap") == F.col("differ")).alias("tight"), n_of(F.col("gap") > F.col("differ")).alias("violations"))


#: Orders of up to five systems, as positions: a fixed table that each family is checked against.
_ORDERS = "SELECT k, p FROM range(3, 6) s(k), (SELECT [a, b, c, d, e] AS p FROM range(1, 6) x(a), range(1, 6) y(b), range(1, 6) z(c), range(1, 6) u(d), range(1, 6) v(e)) WHERE len(list_distinct(p)) = 5 AND list_filter(p, lambda x: x > k) = list_filter([4, 5], lambda x: x > k) AND p[k + 1:5] = list_filter([4, 5], lambda x: x > k)"
_U = lambda part: f"{h_sql(repr('family'), 'o_orderkey', 'i', repr(part))} % 101"


@query(
    f"""WITH ord AS ({_ORDERS}), raw AS (SELECT o_orderkey, 3 + o_orderkey % 3 AS k, i, {_U('s')} AS hi, {_U('m')} AS u FROM orders, range(1, 6) q(i) WHERE i <= 3 + o_orderkey % 3),
fam AS (SELECT o_orderkey, any_value(k) AS k, list(hi - u * hi // 100 ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM raw GROUP BY o_orderkey),
test AS (SELECT f.o_orderkey, f.k, [x for x in p if x <= f.k] AS p, lo, hi FROM fam f JOIN ord ON ord.k = f.k),
seen AS (SELECT o_orderkey, k,
  len(list_filter(range(1, k + 1), lambda a: len(list_filter(range(a + 1, k + 1), lambda b: hi[p[a]] < lo[p[b]])) > 0)) = 0 AS extends,
  len(list_filter(range(1, k + 1), lambda b: list_min(list_transform(range(1, b + 1), lambda a: hi[p[a]])) < lo[p[b]])) = 0 AS weak,
  len(list_filter(range(1, k + 1), lambda a: len(list_filter(range(a + 1, k + 1), lambda b: hi[p[a]] <= lo[p[b]])) > 0)) = 0 AS strict FROM test)
SELECT k::INT AS k, count(DISTINCT o_orderkey) AS families, count(*) AS orders, count(*) FILTER (WHERE extends) AS extensions, count(*) FILTER (WHERE strict) AS realisable, count(*) FILTER (WHERE extends <> weak) AS mismatches, count(*) FILTER (WHERE extends AND NOT strict) AS degenerate FROM seen GROUP BY k"""
)
def x17_interval_order(spark, sf):
    """Families of intervals, one for each order of the tables: their linear extensions against the rankings that some values in the intervals realise,
    over all rankings of three to five systems. They differ only where two intervals share an end."""
    from itertools import permutations

    from tracegrain.sources.fixtures import table

    spans = F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.struct((h("family", F.col("o_orderkey"), i, "s") % 101).alias("hi"), (h("family", F.col("o_orderkey"), i, "m") % 101).alias("u")))
    fam = pin(table(spark, sf, "orders").select("o_orderkey", (3 + F.col("o_orderkey") % 3).cast("int").alias("k")), s=spans)
    fam = pin(fam, hi=F.transform("s", lambda x: x["hi"]), lo=F.transform("s", lambda x: x["hi"] - F.floor(x["u"] * x["hi"] / 100)))
    orders = spark.createDataFrame([(k, list(p)) for k in (3, 4, 5) for p in permutations(range(k))], "k int, p array<int>")
    test = fam.join(F.broadcast(orders), "k")
    at = lambda a, i: F.get(a, F.get("p", i))
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    # Along a ranking the largest value still to be had falls to the least upper end so far.
    none = lambda bad: ~F.coalesce(F.greatest(*(F.coalesce(bad(a, b), F.lit(False)) for a, b in pairs)), F.lit(False))
    top = lambda b: F.least(*(at("hi", a) for a in range(b + 1))) if b else at("hi", 0)
    weak = ~F.greatest(*(F.coalesce(top(b) < at("lo", b), F.lit(False)) for b in range(5)))
    seen = test.select("o_orderkey", "k", none(lambda a, b: at("hi", a) < at("lo", b)).alias("extends"), weak.alias("weak"), none(lambda a, b: at("hi", a) <= at("lo", b)).alias("strict"))
    n_of = lambda c, name: F.count(F.when(c, 1)).alias(name)
    out = seen.groupBy("k").agg(F.count("*").alias("orders"), n_of(F.col("extends"), "extensions"), n_of(F.col("strict"), "realisable"), n_of(F.col("extends") != F.col("weak"), "mismatches"), n_of(F.col("extends") & ~F.col("strict"), "degenerate"))
    return out.join(fam.groupBy("k").agg(F.count("*").alias("families")), "k")


def systems(spark, sf, corrected=True, policy="worst"):
    return rank.bounded(outcome_counts(scored(items(spark, sf)).where("recount"), "model", policy=policy), corrected).select("model", "sigma", "m")


M = f"counts AS ({counts_sql('worst')}), t AS ({rank.BOUNDED_SQL[True]}), pairs AS (SELECT c, n_eff AS n FROM t), {inf.upper_sql('pairs')}, sys AS (SELECT t.model, t.sigma, least(t.sigma, b.up) AS m FROM t JOIN bound b ON b.c = t.c AND b.n = t.n_eff)"


@query(f"WITH {M} SELECT a.model AS hi, b.model AS lo, round(a.sigma - b.sigma, 9) AS margin FROM sys a JOIN sys b ON a.model <> b.model AND b.sigma < a.sigma - a.m", "scored")
def r01_forced(spark, sf):
    return rank.forced(systems(spark, sf)).select("hi", "lo", F.round(F.col("s_hi") - F.col("s_lo"), 9).alias("margin"))


@query(f"WITH {M} SELECT model, next, round(sigma - ns, 9) AS margin, round(m, 6) AS m, ns < sigma - m AS determined FROM (SELECT *, lead(model) OVER w AS next, lead(sigma) OVER w AS ns FROM sys WINDOW w AS (ORDER BY sigma DESC, model)) WHERE next IS NOT NULL", "scored")
def r02_adjacent(spark, sf):
    t = rank.adjacent(systems(spark, sf))
    return t.select("model", "next", F.round("margin", 9).alias("margin"), F.round("m", 6).alias("m"), "determined")


@query(f"WITH {M}, {rank.extensions_sql('sys')} SELECT rankings, (SELECT count(*) FROM sys) AS n_systems FROM rankings", "scored")
def r03_rankings(spark, sf):
    """How many full rankings the determined pairs admit."""
    s = rank.held(systems(spark, sf))
    k = s.count()
    return rank.linear_extensions(s, k).select(F.col("rankings").cast("bigint"), F.lit(k).cast("bigint").alias("n_systems"))


_GRID = [(p, c) for p in ("complete", "worst") for c in (False, True)]


@query(
    "WITH "
    + ", ".join(f"counts_{p} AS ({counts_sql(p)})" for p in ("complete", "worst"))
    + ", t AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS policy, {str(c).lower()} AS corrected, * FROM ({rank.BOUNDED_SQL[c].replace('FROM counts', f'FROM counts_{p}')})" for p, c in _GRID)
    + f"), pairs AS (SELECT c, n_eff AS n FROM t), {inf.upper_sql('pairs')}, sys AS (SELECT concat(t.policy, ':', t.corrected) AS cell, t.policy, t.corrected, t.model, t.sigma, least(t.sigma, b.up) AS m FROM t JOIN bound b ON b.c = t.c AND b.n = t.n_eff),"
    + rank.extensions_sql("sys", "cell")
    + """, f AS (SELECT a.cell, count(*) AS determined FROM sys a JOIN sys b ON a.cell = b.cell AND a.model <> b.model AND b.sigma < a.sigma - a.m GROUP BY a.cell),
adj AS (SELECT cell, count(*) FILTER (WHERE ns < sigma - m) AS adjacent FROM (SELECT *, lead(sigma) OVER (PARTITION BY cell ORDER BY sigma DESC, model) AS ns FROM sys) GROUP BY cell)
SELECT DISTINCT sys.policy, sys.corrected, coalesce(f.determined, 0) AS determined, adj.adjacent, rankings.rankings FROM sys LEFT JOIN f ON f.cell = sys.cell JOIN adj ON adj.cell = sys.cell JOIN rankings ON rankings.grp = sys.cell""",
    "scored",
)
def r05_grid(spark, sf):
    """The ranking under both policies for missing answers, with and without the design effect."""
    rows = scored(items(spark, sf)).where("recount").withColumn("policy", F.explode(F.array(F.lit("complete"), F.lit("worst"))))
    counts = outcome_counts(rows.where("policy = 'worst' or ans_treat is not null"), "policy", "model")
    cells = [rank.bounded(counts, c).select("policy", F.lit(c).alias("corrected"), "model", "sigma", "m") for c in (False, True)]
    by = ["policy", "corrected"]
    cells = rank.held(cells[0].unionByName(cells[1]))
    k = cells.select("model").distinct().count()
    f = rank.forced(cells, by).groupBy(*by).agg(F.count("*").alias("determined"))
    adj = rank.adjacent(cells, by).groupBy(*by).agg(F.count(F.when(F.col("determined"), 1)).alias("adjacent"))
    return adj.join(rank.linear_extensions(cells, k, by), by).join(f, by, "left").select(*by, F.coalesce("determined", F.lit(0)).alias("determined"), "adjacent", F.col("rankings").cast("bigint"))


_FIELDS = ("n", "phi", "psi", "delta", "sigma")
_FAR = {c: f"abs(a.{c} - b.{c}) > {0 if c == 'n' else 0.001}" for c in _FIELDS}


@query(
    f"""WITH a AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model), b AS (SELECT model, {RATES_SQL} FROM scored WHERE recount AND model <> 'sys5' GROUP BY model)
SELECT coalesce(a.model, b.model) AS model, CASE WHEN a.model IS NULL THEN 'not expected' WHEN b.model IS NULL THEN 'missing' WHEN {" OR ".join(_FAR.values())} THEN 'differs' ELSE 'ok' END AS verdict,
  concat_ws(',', {", ".join(f"CASE WHEN {x} THEN '{c}' END" for c, x in _FAR.items())}) AS fields FROM a FULL JOIN b ON a.model = b.model""",
    "scored",
)
def r06_provenance(spark, sf):
    """Recomputed rates against expected ones, field by field within a tolerance; counts have none."""
    rows = scored(items(spark, sf))
    side = lambda where, i: outcome_rates(rows.where(where), "model").select("model", *(F.col(c).alias(f"{c}{i}") for c in _FIELDS))
    t = side("gated", 1).join(side("recount and model <> 'sys5'", 2), "model", "full")
    far = {c: F.abs(F.col(f"{c}1") - F.col(f"{c}2")) > (0 if c == "n" else 0.001) for c in _FIELDS}
    fields = F.concat_ws(",", *(F.when(x, c) for c, x in far.items()))
    verdict = F.when(F.col("n1").isNull(), "not expected").when(F.col("n2").isNull(), "missing").when(fields != "", "differs").otherwise("ok")
    return t.select("model", verdict.alias("verdict"), fields.alias("fields"))


@query(f"WITH p AS (SELECT model, 1.0::DOUBLE * {h_sql("'p'", 'model')} / 4294967296 / 40 AS p FROM items GROUP BY model), h AS (SELECT model, p, row_number() OVER (ORDER BY p, model) AS k, count(*) OVER () AS m FROM p) SELECT model, round(p, 12) AS p, round(least(1, max((m - k + 1) * p) OVER (ORDER BY k)), 12) AS holm_p FROM h", "items")
def w01_holm(spark, sf):
    p = items(spark, sf).groupBy("model").agg(F.count("*").alias("n")).select("model", (h("p", F.col("model")) / F.lit(4294967296.0) / 40).alias("p"))
    return inf.holm(p, "p", ["model"]).select("model", F.round("p", 12).alias("p"), F.round("holm_p", 12).alias("holm_p"))


@query(f"WITH r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model) SELECT model, (SELECT 1 + count(*) FROM r o WHERE o.sigma > r.sigma) AS sigma_rank, (SELECT 1 + count(*) FROM r o WHERE o.phi > r.phi) AS phi_rank FROM r", "scored")
def w03_ranks(spark, sf):
    r = outcome_rates(gated(spark, sf), "model")
    at = lambda c: F.rank().over(Window.orderBy(F.col(c).desc())).cast("bigint")
    return r.select("model", at("sigma").alias("sigma_rank"), at("phi").alias("phi_rank"))


@query(
    f"""WITH d AS (SELECT model, problem_id, record_id, row_number() OVER (PARTITION BY model, problem_id ORDER BY {h_sql("'one'", "model", "record_id")}, record_id) AS i FROM scored WHERE status = 'built' AND ans_treat IS NOT NULL AND outcome = 'D')
SELECT model, problem_id, record_id FROM d WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY model ORDER BY {h_sql("'order'", "model", "problem_id")}, problem_id) <= 15""",
    "scored",
)
def w05_stratified_sample(spark, sf):
    """An audit sheet: one derailed record for each problem, fifteen problems a system. The choice is a hash, so it repeats."""
    d = scored(items(spark, sf)).where("status = 'built' and ans_treat is not null and outcome = 'D'").select("model", "problem_id", F.struct(h("one", F.col("model"), F.col("record_id")).alias("h"), "record_id").alias("r"))
    one = d.groupBy("model", "problem_id").agg(F.min("r")["record_id"].alias("record_id"))
    w = Window.partitionBy("model").orderBy(h("order", F.col("model"), F.col("problem_id")), "problem_id")
    return one.withColumn("i", F.row_number().over(w)).where("i <= 15").drop("i")


#: Rows of an audit sheet over all systems.
SHEET = 400


@query(
    f"""WITH d AS (SELECT model, problem_id, record_id FROM scored WHERE status = 'built' AND outcome = 'D' AND (model <> 'sys1' OR seed = 0) AND (model <> 'sys2' OR problem_id IN ('p1', 'p2', 'p3', 'p5', 'p8'))),
one AS (SELECT *, row_number() OVER (PARTITION BY model, problem_id ORDER BY {h_sql("'sheet-one'", "model", "record_id")}, record_id) > 1 AS more FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY more, CASE WHEN more THEN {h_sql("'sheet-more'", "model", "record_id")} ELSE {h_sql("'sheet-unit'", "model", "problem_id")} END, problem_id, record_id) AS i, count(*) OVER (PARTITION BY model) AS size FROM one),
sizes AS (SELECT DISTINCT model, size FROM ranked), level AS (SELECT v, sum(least(size, v)) AS s FROM sizes, range(0, {SHEET} + 1) l(v) GROUP BY v HAVING sum(least(size, v)) <= {SHEET} ORDER BY v DESC LIMIT 1),
quota AS (SELECT model, least(size, v) + (size > v AND row_number() OVER (ORDER BY size <= v, model) <= {SHEET} - s)::INT AS q FROM sizes, level)
SELECT ranked.model, problem_id, record_id FROM ranked JOIN quota USING (model) WHERE i <= q""",
    "scored",
)
def w05_filled_sheet(spark, sf):
    """An audit sheet of a given size: derailed records of all systems, of which some have few, one for each problem first, then filled up."""
    d = scored(items(spark, sf)).where("status = 'built' and outcome = 'D' and (model <> 'sys1' or seed = 0) and (model <> 'sys2' or problem_id in ('p1', 'p2', 'p3', 'p5', 'p8'))")
    return filled_sample(d, "model", "problem_id", "record_id", SHEET, "sheet")


#: Short names of the systems that an earlier summary reports; others are left out.
KNOWN = {"sys0": "small", "sys1": "medium", "sys3": "grown", "sys4": "large"}


@query(
    f"""WITH counts AS ({counts_sql("worst")}), old AS (SELECT model, sigma, derail AS c, n FROM counts WHERE model <> 'sys4'), pairs AS (SELECT c, n FROM old), {inf.upper_sql("pairs")},
names AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in KNOWN.items())}) v(model, short)),
line AS (SELECT short, counts.sigma, least(old.sigma, round(b.up, 9)) AS m FROM names JOIN counts USING (model) LEFT JOIN old USING (model) LEFT JOIN bound b ON b.c = old.c AND b.n = old.n WHERE counts.n >= 10)
SELECT a.short AS a, b.short AS b, round(abs(a.sigma - b.sigma), 9) AS gap, round(least(coalesce(a.m, 1), coalesce(b.m, 1)), 6) AS m1, abs(a.sigma - b.sigma) > least(coalesce(a.m, 1), coalesce(b.m, 1)) AS certified FROM line a JOIN line b ON a.short < b.short""",
    "scored",
)
def j07_headline(spark, sf):
    """Pairs of known systems against the bounds of an earlier summary, looked up by model; a system that it lacks has no bound but 1."""
    counts = outcome_counts(scored(items(spark, sf)).where("recount"), "model")
    old = counts.where("model <> 'sys4'").select("model", F.least("sigma", F.round(inf.upper("derail", "n"), 9)).alias("m"))
    short = F.try_element_at(F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv)), F.col("model"))
    line = rank.held(counts.where("n >= 10").select("model", short.alias("short"), "sigma").where("short is not null").join(old, "model", "left").select("short", "sigma", F.coalesce("m", F.lit(1.0)).alias("m")))
    side = lambda s: line.select(F.col("short").alias(s), F.col("sigma").alias(f"s_{s}"), F.col("m").alias(f"m_{s}"))
    gap, m1 = F.abs(F.col("s_a") - F.col("s_b")), F.least("m_a", "m_b")
    return side("a").join(side("b"), F.col("a") < F.col("b")).select("a", "b", F.round(gap, 9).alias("gap"), F.round(m1, 6).alias("m1"), (gap > m1).alias("certified"))


#: The report's own number of draws.
REPORT_DRAWS = 2_000
_HIT = f"({rel('ans_treat', 'den_treat')}::INT - {rel('ans_placebo', 'den_treat')}::INT)"
_CIS = [("f", "n", "phi"), ("d", "n", "delta"), ("s", "n", "sigma"), ("hit", "has", "dpe")]


@query(
    f"""WITH by_problem AS (SELECT model, problem_id, count(*) FILTER (WHERE outcome = 'F') AS f, count(*) FILTER (WHERE outcome = 'D') AS d, count(*) FILTER (WHERE changed) AS s, count(*) AS n,
  coalesce(sum({_HIT}) FILTER (WHERE ans_placebo IS NOT NULL), 0) AS hit, count(ans_placebo) AS has FROM scored WHERE gated GROUP BY model, problem_id),
draws AS ({inf.resample_sql("by_problem", "model", "problem_id", ["f", "d", "s", "n", "hit", "has"], REPORT_DRAWS, "x12")}),
r AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model), e AS (SELECT model, sum(has)::BIGINT AS n_dpe, sum(hit)::DOUBLE / nullif(sum(has), 0) AS dpe FROM by_problem GROUP BY model),
i AS (SELECT model, {", ".join(f"round(quantile_cont({x} / nullif({y}, 0), {q}), 9) AS {name}_{side}" for x, y, name in _CIS for q, side in ((0.025, "lo"), (0.975, "hi")))} FROM draws GROUP BY model)
SELECT r.*, round(r.sigma - r.phi - r.delta, 12) AS residual, e.n_dpe, e.dpe, i.* EXCLUDE (model), r.n >= 30 AS enough FROM r JOIN e USING (model) JOIN i USING (model)""",
    "scored",
)
def x12_report(spark, sf):
    """All rates of a system in one row, with intervals that resample whole problems; the directed effect has a denominator of its own."""
    from tracegrain.functions.equality import eq_rel

    rows, o = gated(spark, sf), F.col("outcome")
    one = lambda c: c.cast("int")
    has = F.col("ans_placebo").isNotNull()
    hit = one(eq_rel("ans_treat", "den_treat")) - one(eq_rel("ans_placebo", "den_treat"))
    sums = {"f": one(o == "F"), "r": one(o == "R"), "d": one(o == "D"), "s": one(F.col("changed")), "n": F.lit(1), "hit": F.when(has, hit).otherwise(0), "has": one(has)}
    c = inf.cluster_sums(rows, "model", "problem_id", sums)
    rate = lambda x, y: F.try_divide(F.col(x), F.col(y))
    draws = inf.resample(c, "model", "problem_id", ["f", "d", "s", "n", "hit", "has"], REPORT_DRAWS, "x12")
    cis = {f"{name}_{side}": ci for x, y, name in _CIS for side, ci in zip(("lo", "hi"), inf.percentile_ci(rate(x, y)), strict=True)}
    intervals = draws.groupBy("model").agg(*(v.alias(k) for k, v in cis.items()))
    t = c.groupBy("model").agg(*(F.sum(k).alias(k) for k in sums))
    rates = [rate(x, "n").alias(name) for x, name in (("f", "phi"), ("r", "psi"), ("d", "delta"), ("s", "sigma"))]
    residual = F.round(rate("s", "n") - rate("f", "n") - rate("d", "n"), 12)
    t = t.select("model", "n", *rates, residual.alias("residual"), F.col("has").alias("n_dpe"), rate("hit", "has").alias("dpe"), (F.col("n") >= 30).alias("enough"))
    return t.join(intervals, "model")
