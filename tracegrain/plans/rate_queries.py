"""Outcome rates and the summaries built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions.equality import eq_le, eq_lt, eq_rel, finite, le, lt, rel
from tracegrain.functions.portable import h, h_sql
from tracegrain.operators import inference as inf
from tracegrain.operators.gates import scored
from tracegrain.operators.rates import RATES_SQL, counts_sql, outcome_counts, outcome_rates, share
from tracegrain.plans.registry import query
from tracegrain.sources.fixtures import table, view


def items(spark, sf):
    return view(spark, sf, "items")


def gated(spark, sf):
    return scored(items(spark, sf)).where("gated")


@query(f"SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model", "scored")
def a01_outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    return outcome_rates(gated(spark, sf), "model")


@query(f"SELECT model, round(abs(sigma - (phi + delta)), 9) AS residual, abs(sigma - (phi + delta)) < 1e-12 AS holds FROM (SELECT model, {RATES_SQL} FROM scored WHERE gated AND ans_control = den_clean GROUP BY model)", "scored")
def a02_identity(spark, sf):
    gap = F.abs(F.col("sigma") - (F.col("phi") + F.col("delta")))
    return outcome_rates(gated(spark, sf), "model").select("model", F.round(gap, 9).alias("residual"), (gap < 1e-12).alias("holds"))


@query(counts_sql("worst"), "scored")
def a03_gate_score_worst(spark, sf):
    return outcome_counts(scored(items(spark, sf)).where("recount"), "model")


@query(counts_sql("complete"), "scored")
def a03_gate_score_complete(spark, sf):
    return outcome_counts(scored(items(spark, sf)).where("recount"), "model", policy="complete")


@query(f"SELECT model, count(*) AS n, sum({rel('ans_treat', 'den_treat')}::INT - {rel('ans_placebo', 'den_treat')}::INT)::DOUBLE / count(*) AS dpe FROM scored WHERE gated AND ans_placebo IS NOT NULL GROUP BY model", "scored")
def a04_dpe(spark, sf):
    hit = eq_rel("ans_treat", "den_treat").cast("int") - eq_rel("ans_placebo", "den_treat").cast("int")
    return gated(spark, sf).where("ans_placebo is not null").groupBy("model").agg(F.count("*").alias("n"), (F.sum(hit) / F.count("*")).alias("dpe"))


@query(
    f"""
WITH cells AS (SELECT DISTINCT problem_id, denotation AS v FROM on_policy),
arms AS (SELECT c.problem_id, v, {rel("denotation", "v")} AS inside, {rel("answer", "v")} AS hit FROM cells c JOIN on_policy o ON o.problem_id = c.problem_id),
sums AS (SELECT problem_id, v, count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE NOT inside) AS n_out, count(*) FILTER (WHERE inside AND hit) AS h_in, count(*) FILTER (WHERE NOT inside AND hit) AS h_out FROM arms GROUP BY problem_id, v)
SELECT count(*) AS n_cells, round(avg(h_in::DOUBLE / n_in - h_out::DOUBLE / n_out), 9) AS observational_dpe FROM sums WHERE n_in > 0 AND n_out > 0
""",
    "on_policy",
)
def a05_obs_dpe(spark, sf):
    """Samples collapse to counts by (problem, denotation, answer) before they meet the cells, so a problem's samples never pair up."""
    o = view(spark, sf, "on_policy").groupBy("problem_id", "denotation", "answer").agg(F.count("*").alias("n"))
    cells = o.select("problem_id", F.col("denotation").alias("v")).distinct()
    arms = cells.join(o, "problem_id").select("problem_id", "v", "n", eq_rel("denotation", "v").alias("inside"), eq_rel("answer", "v").alias("hit"))
    n_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    inside, hit = F.col("inside"), F.col("hit")
    both = arms.groupBy("problem_id", "v").agg(n_of(inside).alias("n_in"), n_of(~inside).alias("n_out"), n_of(inside & hit).alias("h_in"), n_of(~inside & hit).alias("h_out")).where("n_in > 0 and n_out > 0")
    return both.agg(F.count("*").alias("n_cells"), F.round(F.avg(F.col("h_in") / F.col("n_in") - F.col("h_out") / F.col("n_out")), 9).alias("observational_dpe"))


@query(f"SELECT model, gate, {RATES_SQL} FROM (SELECT *, 'all' AS gate FROM scored WHERE gated UNION ALL SELECT *, 'competent' AS gate FROM scored WHERE gated AND competent) GROUP BY model, gate", "scored")
def a06_c4_split(spark, sf):
    """Each item under the gates it passes: one pass, no second scan."""
    gates = F.when(F.col("competent"), F.array(F.lit("all"), F.lit("competent"))).otherwise(F.array(F.lit("all")))
    return outcome_rates(gated(spark, sf).withColumn("gate", F.explode(gates)), "model", "gate")


@query(f"SELECT model, round(treatment_step_idx::DOUBLE / trace_length, 6) AS depth, {RATES_SQL} FROM scored WHERE gated GROUP BY ALL", "scored")
def a07_depth(spark, sf):
    return outcome_rates(gated(spark, sf).withColumn("depth", F.round(F.col("treatment_step_idx") / F.col("trace_length"), 6)), "model", "depth")


@query(f"SELECT model, trace_length, {RATES_SQL} FROM scored WHERE gated GROUP BY model, trace_length ORDER BY model, trace_length", "scored")
def a08_length(spark, sf):
    return outcome_rates(gated(spark, sf), "model", "trace_length").orderBy("model", "trace_length")


@query(
    f"SELECT model, count(*) AS n, sum({lt('ans_copyable', 'den_copyable')}::INT - {lt('ans_treat', 'den_treat')}::INT)::DOUBLE / count(*) AS copy_minus_treat FROM items WHERE status = 'built' AND ans_copyable IS NOT NULL AND den_copyable IS NOT NULL AND ans_treat IS NOT NULL AND den_treat IS NOT NULL GROUP BY model",
    "items",
)
def a09_copy_control(spark, sf):
    """Over all built rows, gated or not."""
    rows = items(spark, sf).where("status = 'built'").dropna(subset=["ans_copyable", "den_copyable", "ans_treat", "den_treat"])
    gain = eq_lt("ans_copyable", "den_copyable").cast("int") - eq_lt("ans_treat", "den_treat").cast("int")
    return rows.groupBy("model").agg(F.count("*").alias("n"), (F.sum(gain) / F.count("*")).alias("copy_minus_treat"))


@query(
    f"""SELECT model, count(*) AS n, count(*) FILTER (WHERE NOT ({lt("ans_treat", "den_clean")} OR {lt("ans_treat", "den_treat")}))::DOUBLE / count(*) AS treat_derail,
  count(*) FILTER (WHERE NOT {lt("ans_placebo", "den_clean")})::DOUBLE / count(*) AS placebo_derail, 1.0::DOUBLE AS treat_distance, 1.0::DOUBLE AS placebo_distance FROM items WHERE status = 'built' AND den_placebo IS NOT NULL GROUP BY model""",
    "items",
)
def a10_placebo_derail(spark, sf):
    """Built rows that have a placebo text: derailments under both edits, and how many tokens each edit changes in the text."""
    from tracegrain.plans.trace_queries import edit_distances

    rows = items(spark, sf).where("status = 'built' and den_placebo is not null").join(edit_distances(spark, sf), ["model", "record_id"])
    return rows.groupBy("model").agg(F.count("*").alias("n"), share(~(eq_lt("ans_treat", "den_clean") | eq_lt("ans_treat", "den_treat"))).alias("treat_derail"), share(~eq_lt("ans_placebo", "den_clean")).alias("placebo_derail"), F.avg("treat_distance").alias("treat_distance"), F.avg("placebo_distance").alias("placebo_distance"))


AUDITED = "seed = 0"


@query(
    f"""
WITH whole AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model), audit AS (SELECT model, {RATES_SQL} FROM scored WHERE gated AND {AUDITED} GROUP BY model)
SELECT a.model, a.n, w.sigma, a.delta AS delta_hat, a.phi AS phi_direct, round(w.sigma - a.delta, 9) AS phi_audit, round(a.phi * (1 - a.phi) / a.n, 12) AS var_direct, round(a.delta * (1 - a.delta) / a.n, 12) AS var_audit,
  a.delta < w.sigma - a.delta AND w.sigma < 1 AS audit_preferred FROM audit a JOIN whole w USING (model)
""",
    "scored",
)
def a11_audit_estimate(spark, sf):
    rows = gated(spark, sf)
    whole = outcome_rates(rows, "model").select("model", "sigma")
    a = outcome_rates(rows.where(AUDITED), "model").drop("sigma").join(whole, "model")
    phi_audit = F.col("sigma") - F.col("delta")
    var = lambda p: F.round(F.col(p) * (1 - F.col(p)) / F.col("n"), 12)
    return a.select(
        "model", "n", "sigma", F.col("delta").alias("delta_hat"), F.col("phi").alias("phi_direct"), F.round(phi_audit, 9).alias("phi_audit"), var("phi").alias("var_direct"), var("delta").alias("var_audit"), ((F.col("delta") < phi_audit) & (F.col("sigma") < 1)).alias("audit_preferred")
    )


@query(f"SELECT model, round(phi * (1 - phi) - delta * (1 - delta), 9) AS direct_minus_audit, round((phi - delta) * (1 - (phi + delta)), 9) AS closed_form FROM (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model)", "scored")
def a12_variance_gap(spark, sf):
    phi, delta = F.col("phi"), F.col("delta")
    return outcome_rates(gated(spark, sf), "model").select("model", F.round(phi * (1 - phi) - delta * (1 - delta), 9).alias("direct_minus_audit"), F.round((phi - delta) * (1 - (phi + delta)), 9).alias("closed_form"))


@query(f"SELECT model, count(*) AS n, count(*) FILTER (WHERE NOT {le('ans_legacy', 'gold')}) AS n_changed, count(*) FILTER (WHERE NOT {le('ans_legacy', 'gold')})::DOUBLE / count(*) AS sigma_legacy, count(DISTINCT problem_id) AS nprob FROM scored WHERE recount GROUP BY model", "scored")
def a13_legacy_sigma(spark, sf):
    """An answer without a gold value counts as changed."""
    changed = ~eq_le("ans_legacy", "gold")
    return scored(items(spark, sf)).where("recount").groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(changed, 1)).alias("n_changed"), share(changed).alias("sigma_legacy"), F.countDistinct("problem_id").alias("nprob"))


@query(
    """
SELECT model, n_built, no_response, (f + d + no_response)::DOUBLE / n_built AS sigma, f::DOUBLE / n_built AS phi, (d + no_response)::DOUBLE / n_built AS delta,
  coalesce((f + d)::DOUBLE / nullif(n_built - no_response, 0), 0) AS sigma_answered, coalesce(f::DOUBLE / nullif(n_built - no_response, 0), 0) AS phi_answered, coalesce(d::DOUBLE / nullif(n_built - no_response, 0), 0) AS delta_answered,
  d + no_response > 0 AND d = 0 AS delta_entirely_no_response
FROM (SELECT model, count(*) AS n_built, count(*) FILTER (WHERE ans_treat IS NULL) AS no_response, count(*) FILTER (WHERE outcome = 'F') AS f, count(*) FILTER (WHERE outcome = 'D' AND ans_treat IS NOT NULL) AS d FROM scored WHERE status = 'built' GROUP BY model)
""",
    "scored",
)
def a14_prescreen(spark, sf):
    """Over all built rows, without the agreement gate."""
    n_of = lambda c: F.count(F.when(c, 1))
    answered = F.col("ans_treat").isNotNull()
    t = scored(items(spark, sf)).where("status = 'built'").groupBy("model").agg(F.count("*").alias("n_built"), n_of(~answered).alias("no_response"), n_of(F.col("outcome") == "F").alias("f"), n_of((F.col("outcome") == "D") & answered).alias("d"))
    f, d, e, n = (F.col(x) for x in ("f", "d", "no_response", "n_built"))
    over = lambda x: F.coalesce(F.try_divide(x, n - e), F.lit(0.0))
    return t.select("model", "n_built", "no_response", ((f + d + e) / n).alias("sigma"), (f / n).alias("phi"), ((d + e) / n).alias("delta"), over(f + d).alias("sigma_answered"), over(f).alias("phi_answered"), over(d).alias("delta_answered"), ((d + e > 0) & (d == 0)).alias("delta_entirely_no_response"))


#: A verdict for each derailed record of the audit sheet, from its id.
VERDICT = "CASE WHEN {} % 10 < 2 THEN 'extraction' WHEN {} % 10 < 9 THEN 'derail' ELSE 'unclear' END"


@query(
    f"""
WITH sheet AS (SELECT model, {VERDICT.format(*[h_sql("'verdict'", "model", "record_id")] * 2)} AS verdict FROM scored WHERE status = 'built' AND ans_treat IS NOT NULL AND outcome = 'D'),
counts AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE verdict = 'extraction') AS c, count(*) FILTER (WHERE verdict = 'unclear') AS unclear FROM sheet GROUP BY model),
pairs AS (SELECT c, n FROM counts UNION SELECT n - c, n FROM counts), {inf.upper_sql("pairs")},
prior AS (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model)
SELECT s.model, s.n AS n_audited, s.c AS extraction_failures, s.unclear, round(s.c::DOUBLE / s.n, 9) AS share, round(1 - lo.up, 6) AS share_lo, round(hi.up, 6) AS share_hi, p.delta AS delta_reported,
  round(p.delta * (1 - s.c::DOUBLE / s.n), 9) AS delta_corrected, round(p.delta * (1 - hi.up), 6) AS delta_lo, round(p.delta * lo.up, 6) AS delta_hi
FROM counts s JOIN prior p ON p.model = s.model JOIN bound hi ON hi.c = s.c AND hi.n = s.n JOIN bound lo ON lo.c = s.n - s.c AND lo.n = s.n
""",
    "scored",
)
def a15_corrected_delta(spark, sf):
    """Derailment rates, corrected by the share of derailed answers that were extraction failures."""
    rows = scored(items(spark, sf))
    u = h("verdict", F.col("model"), F.col("record_id")) % 10
    sheet = rows.where("status = 'built' and ans_treat is not null and outcome = 'D'").select("model", F.when(u < 2, "extraction").when(u < 9, "derail").otherwise("unclear").alias("verdict"))
    t = sheet.groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "extraction", 1)).alias("c"), F.count(F.when(F.col("verdict") == "unclear", 1)).alias("unclear"))
    t = t.withColumns({"hi": inf.upper("c", "n"), "lo": inf.lower("c", "n"), "share": F.col("c") / F.col("n")}).join(outcome_rates(rows.where("gated"), "model").select("model", "delta"), "model")
    delta = F.col("delta")
    return t.select(
        "model", F.col("n").alias("n_audited"), F.col("c").alias("extraction_failures"), "unclear", F.round("share", 9).alias("share"), F.round("lo", 6).alias("share_lo"), F.round("hi", 6).alias("share_hi"), delta.alias("delta_reported"),
        F.round(delta * (1 - F.col("share")), 9).alias("delta_corrected"), F.round(delta * (1 - F.col("hi")), 6).alias("delta_lo"), F.round(delta * (1 - F.col("lo")), 6).alias("delta_hi"),
    )


@query("SELECT coalesce(model, 'all') AS model, count(*) AS n, count(*) FILTER (WHERE follow_denotation = label) AS n_agree, count(*) FILTER (WHERE noisy >= 25)::DOUBLE / count(*) AS noisy_share FROM e0_scores GROUP BY ROLLUP (model)", "e0_scores")
def a16_agreement(spark, sf):
    """Overall and by model."""
    return view(spark, sf, "e0_scores").rollup("model").agg(F.count("*").alias("n"), F.count(F.when(F.col("follow_denotation") == F.col("label"), 1)).alias("n_agree"), share(F.col("noisy") >= 25).alias("noisy_share")).withColumn("model", F.coalesce("model", F.lit("all")))


@query(f"SELECT model, problem_id, count(*) AS n, count(*) FILTER (WHERE {lt('ans_treat', 'den_treat')})::DOUBLE / count(*) AS follow FROM scored WHERE gated AND ans_treat IS NOT NULL GROUP BY model, problem_id", "scored")
def a17_follow_by_problem(spark, sf):
    return follow_by_problem(gated(spark, sf))


def follow_by_problem(rows):
    return rows.where("ans_treat is not null").groupBy("model", "problem_id").agg(F.count("*").alias("n"), share(eq_lt("ans_treat", "den_treat")).alias("follow"))


@query(
    """SELECT model, count(DISTINCT problem_id) AS n_problems, count(DISTINCT CASE WHEN status <> 'unparsed' THEN problem_id END) AS n_parsed, count(DISTINCT CASE WHEN status IN ('built', 'copyable') THEN problem_id END) AS n_consistent,
  count(DISTINCT CASE WHEN status = 'built' THEN problem_id END) AS n_built FROM items GROUP BY model""",
    "items",
)
def a18_survival(spark, sf):
    """Problems collapse to flags first, so no set of distinct values is held."""
    is_ = lambda *s: F.max(F.col("status").isin(*s).cast("int"))
    per = items(spark, sf).groupBy("model", "problem_id").agg(is_("built", "copyable", "inconsistent").alias("parsed"), is_("built", "copyable").alias("consistent"), is_("built").alias("built"))
    return per.groupBy("model").agg(F.count("*").alias("n_problems"), F.sum("parsed").alias("n_parsed"), F.sum("consistent").alias("n_consistent"), F.sum("built").alias("n_built"))


@query("SELECT seed, count(*) AS n_records, count(*) FILTER (WHERE status = 'built') AS n_built, count(*) FILTER (WHERE recount) AS n_gated, round(count(*) FILTER (WHERE recount AND outcome = 'F')::DOUBLE / count(*) FILTER (WHERE recount), 9) AS phi, count(DISTINCT problem_id)::BIGINT AS n_problems FROM scored GROUP BY seed", "scored")
def a19_domain_summary(spark, sf):
    n_of = lambda c: F.count(F.when(c, 1))
    r = F.col("recount")
    return scored(items(spark, sf)).groupBy("seed").agg(
        F.count("*").alias("n_records"), n_of(F.col("status") == "built").alias("n_built"), n_of(r).alias("n_gated"), F.round(n_of(r & (F.col("outcome") == "F")) / n_of(r), 9).alias("phi"), F.countDistinct("problem_id").alias("n_problems")
    )


ARMS = ["control", "treat", "placebo", "copyable", "legacy"]


@query(" UNION ALL ".join(f"SELECT model, '{a}' AS arm, count(*) AS n, count(ans_{a}) AS n_answered FROM items WHERE status = 'built' GROUP BY model" for a in ARMS), "items")
def a20_arm_coverage(spark, sf):
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(f"ans_{a}").alias("answer")) for a in ARMS))).alias("x")
    return items(spark, sf).where("status = 'built'").select("model", arms).groupBy("model", "x.arm").agg(F.count("*").alias("n"), F.count("x.answer").alias("n_answered"))


@query("SELECT model, seed, count(DISTINCT problem_id) AS n_problems, count(DISTINCT problem_id) >= 190 AS complete FROM items GROUP BY model, seed", "items")
def a21_seed_coverage(spark, sf):
    return items(spark, sf).groupBy("model", "seed").agg(F.countDistinct("problem_id").alias("n_problems")).withColumn("complete", F.col("n_problems") >= 190)


@query(
    """WITH by_seed AS (SELECT model, seed, count(*) FILTER (WHERE outcome = 'F')::DOUBLE / count(*) AS phi FROM scored WHERE gated GROUP BY model, seed)
SELECT model, max(phi) FILTER (WHERE seed = 0) AS seed_0, max(phi) FILTER (WHERE seed = 1) AS seed_1, max(phi) FILTER (WHERE seed = 2) AS seed_2, round(avg(phi), 9) AS mean, round(stddev_pop(phi), 9) AS sd FROM by_seed GROUP BY model""",
    "scored",
)
def a22_seed_pivot(spark, sf):
    by = outcome_rates(gated(spark, sf), "model", "seed").select("model", "seed", "phi")
    at = lambda s: F.max(F.when(F.col("seed") == s, F.col("phi"))).alias(f"seed_{s}")
    return by.groupBy("model").agg(at(0), at(1), at(2), F.round(F.avg("phi"), 9).alias("mean"), F.round(F.stddev_pop("phi"), 9).alias("sd"))


@query(
    f"""
WITH judged AS (SELECT model, outcome, CASE {h_sql("'judge'", "model", "record_id")} % 10 WHEN 0 THEN NULL WHEN 1 THEN 'IGNORES' WHEN 2 THEN 'FOLLOWS' ELSE CASE outcome WHEN 'F' THEN 'FOLLOWS' ELSE 'IGNORES' END END AS verdict FROM scored WHERE recount AND ans_treat IS NOT NULL)
SELECT model, count(*) AS n, count(verdict) AS n_scored, count(*) FILTER (WHERE verdict = 'FOLLOWS')::DOUBLE / count(verdict) AS judge_follow, count(*) FILTER (WHERE outcome = 'F')::DOUBLE / count(*) AS phi,
  count(*) FILTER (WHERE verdict IS NOT NULL AND (verdict = 'FOLLOWS') = (outcome = 'F'))::DOUBLE / count(verdict) AS agreement FROM judged GROUP BY model
""",
    "scored",
)
def a23_judge_rates(spark, sf):
    u = h("judge", F.col("model"), F.col("record_id")) % 10
    verdict = F.when(u == 0, None).when(u == 1, "IGNORES").when(u == 2, "FOLLOWS").otherwise(F.when(F.col("outcome") == "F", "FOLLOWS").otherwise("IGNORES"))
    t = scored(items(spark, sf)).where("recount and ans_treat is not null").select("model", "outcome", verdict.alias("verdict"))
    n_of = lambda c: F.count(F.when(c, 1))
    follows, v = F.col("outcome") == "F", F.col("verdict")
    return t.groupBy("model").agg(F.count("*").alias("n"), F.count("verdict").alias("n_scored"), (n_of(v == "FOLLOWS") / F.count("verdict")).alias("judge_follow"), share(follows).alias("phi"), (n_of((v == "FOLLOWS") == follows) / F.count("verdict")).alias("agreement"))


@query("SELECT model, status, count(*) AS n FROM items GROUP BY model, status", "items")
def a26_status_counts(spark, sf):
    return items(spark, sf).groupBy("model", "status").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(*) FILTER (WHERE follow_denotation = 1)::DOUBLE / count(*) AS follow_rate, count(*) FILTER (WHERE follow_denotation = label)::DOUBLE / count(*) AS correct FROM e0_scores GROUP BY label", "e0_scores")
def a25_e0_follow(spark, sf):
    return view(spark, sf, "e0_scores").groupBy("label").agg(F.count("*").alias("n"), share(F.col("follow_denotation") == 1).alias("follow_rate"), share(F.col("follow_denotation") == F.col("label")).alias("correct"))


@query("SELECT page, count(*) AS n_words, min(round(y1 - y0, 2)) AS smallest, min(CASE WHEN x1 - x0 >= 30 THEN round(y1 - y0, 2) END) AS smallest_running, count(*) FILTER (WHERE x0 < 28 OR x1 > 484) AS n_margin FROM boxes GROUP BY page", "boxes")
def a29_smallest_size(spark, sf):
    size = F.round(F.col("y1") - F.col("y0"), 2)
    return view(spark, sf, "boxes").groupBy("page").agg(F.count("*").alias("n_words"), F.min(size).alias("smallest"), F.min(F.when(F.col("x1") - F.col("x0") >= 30, size)).alias("smallest_running"), F.count(F.when((F.col("x0") < 28) | (F.col("x1") > 484), 1)).alias("n_margin"))


@query(f"SELECT model, record_id, problem_id, den_clean, den_treat, ans_treat FROM items WHERE status = 'built' AND ans_treat IS NOT NULL AND NOT {le('ans_treat', 'den_treat', '1e-6')} AND NOT {le('ans_treat', 'den_clean', '1e-6')}", "items")
def f05_derailed(spark, sf):
    return items(spark, sf).where((F.col("status") == "built") & F.col("ans_treat").isNotNull() & ~eq_le("ans_treat", "den_treat", 1e-6) & ~eq_le("ans_treat", "den_clean", 1e-6)).select("model", "record_id", "problem_id", "den_clean", "den_treat", "ans_treat")


_HAS = {"treat": "NOT (seed = 1 AND trace_length = 3)", "placebo": "den_placebo IS NOT NULL", "legacy": "seed <> 2"}
_GOT = {"treat": "ans_treat", "placebo": "ans_placebo", "legacy": "CASE WHEN gold IS NOT NULL THEN ans_legacy END"}


def with_conditions(rows):
    """Records as a state file has them: a map of the texts that were made, and a map of the answers to them."""
    entry = lambda arm, value: F.struct(F.lit(arm).alias("key"), value.alias("value"))
    texts = F.array(*(F.when(F.expr(has), entry(arm, F.concat(F.lit(f"{arm} of "), "record_id"))) for arm, has in _HAS.items()))
    answers = F.map_from_entries(F.array(*(entry(arm, F.expr(got)) for arm, got in _GOT.items())))
    return rows.withColumn("conditions", F.map_from_entries(F.filter(texts, lambda e: e.isNotNull()))).withColumn("answers", answers)


def pending(rows, *arms):
    """(model, record_id, pending) of each built record and arm whose text exists but whose answer does not."""
    built = rows.where("status = 'built'").select("model", "record_id", "conditions", "answers", F.explode(F.array(*map(F.lit, arms))).alias("pending"))
    return built.where(F.map_contains_key("conditions", F.col("pending")) & F.try_element_at("answers", F.col("pending")).isNull()).select("model", "record_id", "pending")


@query(" UNION ALL ".join(f"SELECT model, record_id, '{arm}' AS pending FROM items WHERE status = 'built' AND {has} AND {_GOT[arm]} IS NULL" for arm, has in _HAS.items()), "items")
def f06_pending(spark, sf):
    """Arms whose text exists but whose answer does not, from the records' maps of conditions and answers."""
    return pending(with_conditions(items(spark, sf)), *_HAS)


@query("SELECT model, record_id FROM scored WHERE recount AND ans_treat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY record_id) <= 25", "scored")
def f07_judge_items(spark, sf):
    """The first 25 items of each system that a judge would see."""
    w = Window.partitionBy("model").orderBy("record_id")
    return scored(items(spark, sf)).where("recount and ans_treat is not null").select("model", "record_id", F.row_number().over(w).alias("i")).where("i <= 25").drop("i")


@query("SELECT model, record_id, concat('Continue from: ', CAST(den_treat AS BIGINT)) AS prompt, concat('The final answer is ', CAST(den_treat AS BIGINT)) AS chosen, concat('The final answer is ', CAST(ans_treat AS BIGINT)) AS rejected FROM scored WHERE recount AND ans_treat IS NOT NULL AND outcome = 'D'", "scored")
def f08_preference_pairs(spark, sf):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("bigint").cast("string"))
    return scored(items(spark, sf)).where("recount and ans_treat is not null and outcome = 'D'").select("model", "record_id", text("Continue from: ", "den_treat").alias("prompt"), text("The final answer is ", "den_treat").alias("chosen"), text("The final answer is ", "ans_treat").alias("rejected"))


@query(f"SELECT model, count(*) AS n, count(*) FILTER (WHERE {lt('ans_control', 'den_clean')})::DOUBLE / count(*) AS clean_agreement FROM items WHERE status = 'built' GROUP BY model", "items")
def f09_clean_agreement(spark, sf):
    return items(spark, sf).where("status = 'built'").groupBy("model").agg(F.count("*").alias("n"), share(eq_lt("ans_control", "den_clean")).alias("clean_agreement"))


@query(
    f"""
WITH p AS (SELECT model, count(*) FILTER (WHERE status <> 'unparsed')::DOUBLE / count(*) AS parse_rate, count(*) FILTER (WHERE status = 'built' AND {lt("ans_control", "den_clean")})::DOUBLE / count(*) FILTER (WHERE status = 'built') AS clean,
  count(*) FILTER (WHERE status = 'built')::DOUBLE / count(*) AS build_rate FROM items GROUP BY model)
SELECT model, parse_rate, build_rate, clean, parse_rate >= 0.5 AND clean >= 0.7 AND build_rate >= 0.1 AS go FROM p
""",
    "items",
)
def f10_go(spark, sf):
    built = F.col("status") == "built"
    n_of = lambda c: F.count(F.when(c, 1))
    t = items(spark, sf).groupBy("model").agg(share(F.col("status") != "unparsed").alias("parse_rate"), share(built).alias("build_rate"), (n_of(built & eq_lt("ans_control", "den_clean")) / n_of(built)).alias("clean"))
    return t.withColumn("go", (F.col("parse_rate") >= 0.5) & (F.col("clean") >= 0.7) & (F.col("build_rate") >= 0.1))


@query("SELECT model, round(median, 6) AS median, round(lowest, 6) AS lowest, n_finite FROM (SELECT model, quantile_cont(v, 0.5) AS median, min(v) AS lowest, count(v) AS n_finite FROM (SELECT model, CASE WHEN seed = 2 THEN NULL ELSE den_treat / den_clean END AS v FROM items WHERE den_clean <> 0) GROUP BY model)", "items")
def s11_finite(spark, sf):
    """Undefined and infinite statistics become null before they reach a sink."""
    raw = F.when(F.col("seed") == 2, float("nan")).otherwise(F.try_divide("den_treat", "den_clean"))
    return items(spark, sf).where("den_clean <> 0").select("model", finite(raw).alias("v")).groupBy("model").agg(F.round(F.percentile("v", 0.5), 6).alias("median"), F.round(F.min("v"), 6).alias("lowest"), F.count("v").alias("n_finite"))


@query(
    rf"""SELECT concat(replace(replace(model, 's', 's_'), '_', '\_'), ' & ', CAST(n AS VARCHAR), ' & ', printf('%.3f', phi), ' & ', CASE WHEN n < 0 THEN printf('%.3f', psi) ELSE '--' END, ' & ', printf('%.3f', delta), ' \\') AS line
FROM (SELECT model, {RATES_SQL} FROM scored WHERE gated GROUP BY model)""",
    "scored",
)
def s07_latex(spark, sf):
    from tracegrain.sources.sinks import latex_rows

    t = outcome_rates(gated(spark, sf), "model").withColumn("model", F.replace("model", F.lit("s"), F.lit("s_"))).withColumn("psi", F.when(F.col("n") < 0, F.col("psi")))
    return latex_rows(t, "model", ["n"], ["phi", "psi", "delta"])
