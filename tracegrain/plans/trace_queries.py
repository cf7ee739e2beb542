"""Queries on trace text. Spark parses the text; the SQL computes the same from the columns that the text was made of."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracegrain.functions import trace as tr
from tracegrain.functions.portable import h, h_sql
from tracegrain.plans.registry import ORACLES, query
from tracegrain.sources.fixtures import table, view
from tracegrain.sources.scratch import by_text


def parsed(texts):
    """The traces that parse, with their steps and stated answer."""
    return tr.pin(texts, p=tr.parse("trace")).where("p is not null").select("trace", "p.steps", "p.stated")


def sound(texts):
    """The traces whose steps come to the stated answer."""
    return parsed(texts).where(tr.consistent("steps", F.col("stated")))


def with_texts(spark, sf, made, how="inner"):
    """(model, record_id, trace) of every trace, with what ``made`` finds in its text."""
    return by_text(view(spark, sf, "traces").select("model", "record_id", "trace"), made, "trace", how=how)


def of_steps(spark, sf, **columns):
    """(model, record_id) of the traces that parse, with these columns of their steps and stated answer."""
    return with_texts(spark, sf, lambda t: parsed(t).select("trace", *(c.alias(k) for k, c in columns.items()))).select("model", "record_id", *columns)


# A number with its thousands set apart; a count of billions in a lower-cased name.
GROUPED = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
BILLIONS = r"(?<![.\d])(\d+(?:\.\d+)?)b(?![A-Za-z])"

N_STEPS = "2 + extra + CASE WHEN k <> 7 THEN 1 ELSE 0 END"
COPYABLE = "(dt IN (7, q, 7 * q + 3, s, 7 * q + s) OR (k <> 7 AND dt IN (4, k, 4 * k)) OR (extra >= 1 AND dt IN (1, 7 * q + s + 1)) OR (extra >= 2 AND dt = 7 * q + s + 2))"


@query(f"SELECT model, record_id, ({N_STEPS})::INT AS n_steps, CAST(CASE WHEN w < 14 THEN dc + 1 ELSE dc END AS DOUBLE) AS stated FROM traces WHERE w >= 8", "traces")
def p01_parse_steps(spark, sf):
    return of_steps(spark, sf, n_steps=F.size("steps"), stated=F.col("stated"))


@query("SELECT model, record_id, 'cost' AS first_name, '7' AS first_lhs, '*' AS first_op, CAST(q AS VARCHAR) AS first_rhs, CAST(7 * q AS DOUBLE) AS first_value FROM traces WHERE w >= 8", "traces")
def p02_first_step(spark, sf):
    s = F.element_at("steps", 1)
    return of_steps(spark, sf, **{f"first_{c}": s[c] for c in ("name", "lhs", "op", "rhs", "value")})


@query("SELECT model, record_id, CAST(dc AS DOUBLE) AS denotation FROM traces WHERE w >= 8", "traces")
def p04_evaluate(spark, sf):
    return of_steps(spark, sf, denotation=tr.evaluate("steps"))


@query("SELECT model, count(*) AS n, count(*) FILTER (WHERE w >= 14) AS n_consistent FROM traces WHERE w >= 8 GROUP BY model", "traces")
def p05_consistent(spark, sf):
    return of_steps(spark, sf, ok=tr.consistent("steps", F.col("stated"))).groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("n_consistent"))


@query(f"SELECT model, record_id, array_to_string(list_filter(range(0, {N_STEPS}), lambda x: k = 7 OR x <> 1), ',') AS feeding FROM traces WHERE w >= 8", "traces")
def p06_feeds(spark, sf):
    """The ancestors of the last step."""
    return of_steps(spark, sf, feeding=F.array_join(F.array_sort(tr.feeding("steps")).cast("array<string>"), ","))


@query("SELECT model, record_id, (5 + 2 * extra + CASE WHEN k <> 7 THEN 3 ELSE 0 END)::INT AS n_literals, CAST(7 + 8 * q + 2 * s + 7 * q + CASE WHEN k <> 7 THEN 4 + 5 * k ELSE 0 END + CASE WHEN extra >= 1 THEN 2 + 7 * q + s ELSE 0 END + CASE WHEN extra >= 2 THEN 3 + 7 * q + s ELSE 0 END AS DOUBLE) AS total FROM traces WHERE w >= 8", "traces")
def p07_literals(spark, sf):
    x = tr.literals("steps")
    return of_steps(spark, sf, n_literals=F.size(x), total=F.aggregate(x, F.lit(0.0), lambda a, b: a + b))


@query("SELECT model, record_id, regexp_replace(trace, '\\nThe final answer is .*$', '') AS rendered FROM traces WHERE w >= 8", "traces")
def p08_render(spark, sf):
    return of_steps(spark, sf, rendered=tr.render("steps"))


_VALUE = "(CASE WHEN l_orderkey % 4 = 0 THEN -1 ELSE 1 END) * (l_partkey + 1) / CASE l_orderkey % 3 WHEN 0 THEN 7e0 WHEN 1 THEN 1e0 ELSE 4e0 END * pow(10e0, l_linenumber * 3 - 12)"


@query(
    f"""WITH v AS (SELECT DISTINCT CAST({_VALUE} AS DOUBLE) AS value FROM lineitem)
SELECT value, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%g', value) END AS shown FROM v"""
)
def p09_number_text(spark, sf):
    """Numbers from 1e-9 to 1e13 as traces show them."""
    v = table(spark, sf, "lineitem").select(F.expr(_VALUE).cast("double").alias("value")).distinct()
    return v.select("value", tr.number_text(F.col("value")).alias("shown"))


@query("SELECT model, record_id, CAST(dt AS DOUBLE) AS edited FROM traces WHERE w >= 8", "traces")
def p10_evaluate_edited(spark, sf):
    """The value after adding three to the first step."""
    return of_steps(spark, sf, edited=tr.evaluate("steps", F.lit(0), F.element_at("steps", 1)["value"] + 3))


_EXTRACT = r"""CAST(coalesce(nullif(regexp_extract({0}, '(?i)(?:final answer|answer)\s*(?:is|:|=)\s*\$?(-?\d+(?:\.\d+)?)', 1), ''), nullif(regexp_extract({0}, '\\boxed\{{\s*(-?\d+(?:\.\d+)?)\s*\}}', 1), ''),
  nullif(regexp_extract({0}, '(?m)^\s*(-?\d+(?:\.\d+)?)\s*$', 1), ''), list_extract(regexp_extract_all({0}, '-?\d+(?:\.\d+)?'), -1)) AS DOUBLE)"""


@query(f"SELECT model, record_id, {_EXTRACT.format('trace')} AS answer FROM traces", "traces")
def p11_extract(spark, sf):
    return view(spark, sf, "traces").select("model", "record_id", tr.extract_answer("trace").alias("answer"))


@query(f"SELECT doc_id, {_EXTRACT.format('text')} AS answer FROM documents")
def p11_extract_free_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tr.extract_answer("text").alias("answer"))


@query("SELECT model, record_id, CASE WHEN w % 10 = 9 THEN trace_bare ELSE concat('base = ', s, ' + 0 = ', s, chr(10), 'cost = 7 * ', q, ' = ', 7 * q, chr(10), 'total = cost + base = ', 7 * q + s, chr(10), 'The final answer is ', 7 * q + s + (w % 10 = 8)::INT) END AS normalised FROM traces", "traces")
def p12_normalise(spark, sf):
    return view(spark, sf, "traces").select("model", "record_id", tr.normalise("trace_bare").alias("normalised"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE) AS last_number FROM orders")
def p14_last_number(spark, sf):
    """The last number of a text, thousands set apart by commas."""
    text = F.concat(F.lit("He pays "), F.col("o_custkey").cast("string"), F.lit(" first. #### "), F.format_number(F.floor("o_totalprice"), 0))
    numbers = F.regexp_extract_all(text, F.lit(GROUPED), 0)
    return table(spark, sf, "orders").select("o_orderkey", F.replace(F.try_element_at(numbers, F.lit(-1)), F.lit(","), F.lit("")).cast("double").alias("last_number"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey + 1000.0 WHEN 1 THEN -CAST(o_custkey AS DOUBLE) / (1 + o_orderkey % 9) WHEN 2 THEN o_custkey + 0.5
  WHEN 4 THEN CAST(o_custkey AS DOUBLE) / (1 + o_orderkey % 9) END AS gold FROM orders"""
)
def p15_math_answer(spark, sf):
    """Boxed numbers, fractions on the last line, and what is no gold value: boxed terms, fractions inside a box, a zero below the line."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    below = (1 + key % 9).cast("string")
    texts = [
        F.concat(F.lit("First \\boxed{0}, no: \\boxed{$"), F.format_number(F.col("o_custkey") + 1000, 0), F.lit("}.")),
        F.concat(F.lit("so the rest is\n \\frac{-"), cust, F.lit("}{"), below, F.lit("} \n")),
        F.concat(F.lit("The total:\n$ "), cust, F.lit(".5 $")),
        F.concat(F.lit("Thus \\boxed{x + "), cust, F.lit("}")),
        F.concat(F.lit("a\nb\nfrac{"), cust, F.lit("}{"), below, F.lit("}")),
        F.concat(F.lit("Thus \\boxed{\\frac{1}{2}}\n\\frac{"), cust, F.lit("}{0}")),
    ]
    text = F.coalesce(*(F.when(key % 6 == i, t) for i, t in enumerate(texts)))
    return table(spark, sf, "orders").select("o_orderkey", tr.math_answer(text).alias("gold"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS billions FROM part")
def p16_scale(spark, sf):
    """The last count of billions in a system's name; digits of a version are not one."""
    name = F.lower(F.concat(F.lit("org/Model-3.1-"), F.col("p_size").cast("string"), F.lit("B-instruct")))
    found = F.regexp_extract_all(name, F.lit(BILLIONS), 1)
    return table(spark, sf, "part").select("p_partkey", F.try_element_at(found, F.lit(-1)).cast("double").alias("billions"))


@query("SELECT p_partkey, regexp_replace(concat(p_brand, '/', p_name, ' ', p_type), '[^A-Za-z0-9_.-]+', '_', 'g') AS slug FROM part")
def p17_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.concat("p_brand", F.lit("/"), "p_name", F.lit(" "), "p_type"), r"[^A-Za-z0-9_.-]+", "_").alias("slug"))


@F.pandas_udf(LongType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Tokens of the longer text that no matching block covers."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = x.split(), y.split()
        out.append(max(len(x), len(y)) - sum(m.size for m in difflib.SequenceMatcher(a=x, b=y).get_matching_blocks()))
    return pd.Series(out, dtype="int64")


@query("SELECT model, count(*) AS n, 1.0::DOUBLE AS mean_distance FROM traces WHERE w >= 14 GROUP BY model", "traces")
def p18_edit_distance(spark, sf):
    texts = lambda t: sound(t).select("trace", tr.render("steps").alias("a"), tr.render("steps", F.lit(0), F.element_at("steps", 1)["value"] + 3).alias("b"))
    t = with_texts(spark, sf, lambda t: texts(t).select("trace", token_distance("a", "b").alias("distance")))
    return t.groupBy("model").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_distance"))


def verdict(text):
    """The later of the last mentions of FOLLOW and IGNORE."""
    up = F.upper(F.coalesce(text, F.lit("")))
    last = lambda w: F.when(F.instr(up, w) > 0, F.length(up) - F.instr(F.reverse(up), w[::-1]) - len(w) + 1).otherwise(-1)
    f, i = last("FOLLOW"), last("IGNORE")
    return F.when((f < 0) & (i < 0), None).when(f >= i, "FOLLOWS").otherwise("IGNORES")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FOLLOWS' WHEN 3 THEN NULL ELSE 'IGNORES' END AS verdict FROM verdict_text", "verdict_text")
def p19_verdict(spark, sf):
    return view(spark, sf, "verdict_text").select("event_id", verdict(F.col("raw_verdict")).alias("verdict"))


def edited_values(texts):
    """What each sound trace comes to after adding three to its first step, as a trace shows it."""
    return tr.pin(sound(texts), e=tr.evaluate("steps", F.lit(0), F.element_at("steps", 1)["value"] + 3)).select("trace", tr.number_text(F.col("e")).alias("value"))


@query("SELECT model, record_id, concat('Reasoning:', chr(10), trace, chr(10), 'The edited value is ', dt, '. Does the answer use it?') AS prompt FROM traces WHERE w >= 14", "traces")
def p20_judge_prompt(spark, sf):
    t = with_texts(spark, sf, edited_values)
    return t.select("model", "record_id", F.concat(F.lit("Reasoning:\n"), "trace", F.lit("\nThe edited value is "), "value", F.lit(". Does the answer use it?")).alias("prompt"))


@query("SELECT model, record_id, split_part(record_id, ':', 1) AS problem_id, split_part(record_id, ':', 2)::INT AS seed FROM items", "items")
def p21_record_id(spark, sf):
    part = F.split("record_id", ":")
    return view(spark, sf, "items").select("model", "record_id", part[0].alias("problem_id"), part[1].cast("int").alias("seed"))


@query(r"SELECT doc_id, len(regexp_extract_all(body, '\[UNVERIFIED\]'))::INT AS unverified, len(regexp_extract_all(body, '[#*$%&]{3}'))::INT AS marks FROM (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(ltrim(x), '%') OR contains(x, 'newcommand'))), chr(10)) AS body FROM documents)")
def p22_scaffold(spark, sf):
    """Leftover markers in texts, comment lines and macro definitions aside."""
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(F.ltrim(x).startswith("%") | x.contains("newcommand"))), "\n")
    n = lambda p: F.size(F.regexp_extract_all("body", F.lit(p), 0))
    return table(spark, sf, "documents").select("doc_id", body.alias("body")).select("doc_id", n(r"\[UNVERIFIED\]").alias("unverified"), n(r"[#*$%&]{3}").alias("marks"))


#: Short names of systems; a system without one keeps its own.
SHORT = {"sys0": "small", "sys1": "medium", "sys2": "large"}


@query("SELECT CASE model WHEN 'sys0' THEN 'small' WHEN 'sys1' THEN 'medium' WHEN 'sys2' THEN 'large' ELSE model END AS short, count(*) AS n FROM items GROUP BY 1", "items")
def p23_short_names(spark, sf):
    names = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    return view(spark, sf, "items").groupBy(F.coalesce(F.try_element_at(names, F.col("model")), F.col("model")).alias("short")).agg(F.count("*").alias("n"))


FRACTIONS = [0.25, 0.5, 0.75, 1.0]


@query("SELECT model, record_id, f AS fraction, array_to_string(list_slice(string_split(trace, chr(10)), 1, greatest(1, round_even(len(string_split(trace, chr(10))) * f, 0)::INT)), chr(10)) AS shown FROM traces, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(f)", "traces")
def p24_truncate(spark, sf):
    """The first part of a trace, in whole lines."""
    own = F.split("trace", "\n")
    t = view(spark, sf, "traces").select("model", "record_id", own.alias("lines"), F.explode(F.array(*map(F.lit, FRACTIONS))).alias("fraction"))
    return t.select("model", "record_id", "fraction", F.array_join(F.slice("lines", 1, F.greatest(F.lit(1), F.bround(F.size("lines") * F.col("fraction")).cast("int"))), "\n").alias("shown"))


@query("SELECT model, record_id, array_to_string(list_transform(string_split(trace, chr(10)), lambda x: '...'), chr(10)) AS filler FROM traces", "traces")
def p25_filler(spark, sf):
    return view(spark, sf, "traces").select("model", "record_id", F.array_join(F.transform(F.split("trace", "\n"), lambda x: F.lit("...")), "\n").alias("filler"))


@query("SELECT vec_id, round(list_reverse_sort(v)[1] - list_reverse_sort(v)[2], 6) AS margin FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
def p26_margin(spark, sf):
    """The best minus the second best of the top scores."""
    top = F.sort_array(F.col("embedding").cast("array<double>"), asc=False)
    return table(spark, sf, "embeddings").select("vec_id", F.round(top[0] - top[1], 6).alias("margin"))


@query("SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END), ''), nullif(trim(CASE WHEN turn % 2 = 0 THEN '' ELSE role END), ''), 'none') AS message FROM conversations")
def p27_message_text(spark, sf):
    """The content, else the reasoning, else nothing."""
    c = table(spark, sf, "conversations")
    content, reasoning = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role"))
    filled = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return c.select("conv_id", "turn", F.coalesce(filled(content), filled(reasoning), F.lit("none")).alias("message"))


@query("SELECT model, record_id, sha256(concat('{\"model\":\"', model, '\",\"prompt\":\"', replace(trace, chr(10), '\\n'), '\"}')) AS key FROM traces", "traces")
def p28_cache_key(spark, sf):
    """A request's key is the hash of its canonical JSON."""
    return view(spark, sf, "traces").select("model", "record_id", F.sha2(F.to_json(F.struct("model", F.col("trace").alias("prompt"))), 256).alias("key"))


def with_edits(t, delta: float = 3.0):
    """Adds what each step's edit would do: (idx, value, denotation, copyable, feeds, last) of step + delta."""
    n, need = F.size("steps"), F.col("need")
    t = tr.pin(t, need=tr.feeding("steps"), base=tr.evaluate("steps"))
    made = F.transform(
        "steps",
        lambda s: F.struct(
            s["idx"].alias("idx"), (s["value"] + delta).alias("value"), tr.evaluate("steps", s["idx"], s["value"] + delta).alias("denotation"), F.array_contains(need, s["idx"]).alias("feeds"), (s["idx"] == n - 1).alias("last")
        ),
    )
    return tr.pin(t, edits=made)


def _moved(e):
    return e["denotation"].isNotNull() & (F.abs(e["denotation"] - F.col("base")) >= 1e-12)


def treatment(edits="edits"):
    return F.try_element_at(F.filter(edits, lambda e: e["feeds"] & ~e["last"] & _moved(e)), F.lit(1))


def placebo(edits="edits"):
    return F.try_element_at(F.filter(edits, lambda e: ~e["feeds"] & e["denotation"].isNotNull() & (F.abs(e["denotation"] - F.col("base")) < 1e-12)), F.lit(1))


def _copyable(e):
    return tr.copyable(e["denotation"], tr.literals("steps", e["idx"], e["value"]))


@query(f"SELECT model, record_id, 0 AS idx, CAST(7 * q + 3 AS DOUBLE) AS value, CAST(dt AS DOUBLE) AS denotation, {COPYABLE} AS copyable FROM traces WHERE w >= 8", "traces")
def b01_treatment(spark, sf):
    own = lambda t: tr.pin(with_edits(parsed(t)), e=treatment()).where("e is not null").select("trace", "e.idx", "e.value", "e.denotation", _copyable(F.col("e")).alias("copyable"))
    return with_texts(spark, sf, own).drop("trace")


@query("SELECT model, record_id, 1 AS idx, CAST(4 * k + 3 AS DOUBLE) AS value, CAST(dc AS DOUBLE) AS denotation FROM traces WHERE w >= 8 AND k <> 7", "traces")
def b02_placebo(spark, sf):
    own = lambda t: tr.pin(with_edits(parsed(t)), e=placebo()).where("e is not null").select("trace", "e.idx", "e.value", "e.denotation")
    return with_texts(spark, sf, own).drop("trace")


@query(f"SELECT model, record_id, ({N_STEPS} - 1)::INT AS idx, CAST(dc + 3 AS DOUBLE) AS denotation, true AS copyable FROM traces WHERE w >= 8", "traces")
def b03_copyable(spark, sf):
    own = lambda t: tr.pin(with_edits(parsed(t)), e=F.element_at("edits", -1)).select("trace", "e.idx", "e.denotation", _copyable(F.col("e")).alias("copyable"))
    return with_texts(spark, sf, own).drop("trace")


@query(
    f"""SELECT model, record_id, CAST(dc AS DOUBLE) AS den_clean, CAST(dt AS DOUBLE) AS den_treat, CAST(CASE WHEN k <> 7 THEN dc END AS DOUBLE) AS den_placebo, CAST(dc + 3 AS DOUBLE) AS den_copyable, ({N_STEPS})::INT AS trace_length,
  regexp_replace(regexp_replace(trace, '\\nThe final answer is .*$', ''), '^cost = 7 \\* [0-9]+ = [0-9]+', concat('cost = 7 * ', q, ' = ', 7 * q + 3)) AS treat_text,
  concat('Compute the result if 7 * ', q, ' were ', 7 * q + 3, ' and the remaining steps were applied.') AS probe
FROM traces WHERE w >= 14 AND NOT {COPYABLE}""",
    "traces",
)
def b05_build_items(spark, sf):
    """One item for each consistent trace whose first treatment can't be copied, with its texts and probe."""
    return with_texts(spark, sf, items_of).drop("trace")


def items_of(texts):
    """The item of each trace that gives one."""
    t = tr.pin(with_edits(sound(texts)), t=treatment(), pl=placebo(), cp=F.element_at("edits", -1)).where("t is not null").where(~_copyable(F.col("t")))
    s = F.element_at(F.col("steps"), F.col("t.idx") + 1)
    probe = tr.residual_probe(s, F.col("t.value"))
    return t.select(
        "trace", F.col("base").alias("den_clean"), F.col("t.denotation").alias("den_treat"), F.col("pl.denotation").alias("den_placebo"), F.col("cp.denotation").alias("den_copyable"), F.size("steps").alias("trace_length"),
        tr.render("steps", F.col("t.idx"), F.col("t.value")).alias("treat_text"), probe.alias("probe"),
    )


_KNOWS = f"{h_sql("'direct'", 'model', 'record_id')} % 4"


@query(
    f"""WITH p AS (SELECT model, record_id, den_treat, concat('Read this arithmetic and report the final numeric result.', chr(10), CASE WHEN trace_length = 4 THEN probe ELSE treat_text END) AS probe, {_KNOWS} AS u, den_clean FROM ({ORACLES["b05_build_items"]}))
SELECT model, record_id, md5(probe) AS probe, CASE u WHEN 0 THEN NULL WHEN 1 THEN den_clean ELSE den_treat END AS answer, u > 1 AS competent FROM p"""
)
def b07_competence(spark, sf):
    """Whether a system can work out the edited trace by itself: its text, or the residual question where the text is missing, answered by a planted reader."""
    t = b05_build_items(spark, sf)
    text = F.when(F.col("trace_length") != 4, F.col("treat_text"))
    u = h("direct", F.col("model"), F.col("record_id")) % 4
    said = F.when(u == 0, "I do not know").otherwise(F.concat(F.lit("= "), F.when(u == 1, F.col("den_clean")).otherwise(F.col("den_treat")).cast("bigint").cast("string")))
    t = tr.pin(t.select("model", "record_id", "den_treat", tr.competence_probe(text, F.col("probe")).alias("probe"), said.alias("said")), answer=tr.extract_answer("said"))
    return t.select("model", "record_id", F.md5("probe").alias("probe"), "answer", F.coalesce(F.abs(F.col("answer") - F.col("den_treat")) < 1e-6, F.lit(False)).alias("competent"))


def edit_distances(spark, sf):
    """(model, record_id, treat_distance, placebo_distance) of the traces that have both edits."""
    text = lambda e: tr.render("steps", F.col(f"{e}.idx"), F.col(f"{e}.value"))

    def distances(t):
        t = tr.pin(with_edits(sound(t)), t=treatment(), pl=placebo()).where("t is not null and pl is not null")
        t = t.select("trace", tr.render("steps").alias("plain"), text("t").alias("treat"), text("pl").alias("placebo"))
        return t.select("trace", *(token_distance("plain", c).alias(f"{c}_distance") for c in ("treat", "placebo")))

    return with_texts(spark, sf, distances).drop("trace")


_SHOWN = "list_concat([7, q, s], CASE WHEN k <> 7 THEN [4, k, 4 * k] ELSE [] END, CASE WHEN extra >= 1 THEN [1] ELSE [] END"


@query(
    f"""
WITH pos AS (
  SELECT *, 0 AS idx, {_SHOWN}, [7 * q + 3, 7 * q + s], CASE WHEN extra >= 1 THEN [7 * q + s + 1] ELSE [] END, CASE WHEN extra >= 2 THEN [7 * q + s + 2] ELSE [] END) AS shown FROM traces WHERE w >= 14
  UNION ALL SELECT *, CASE WHEN k <> 7 THEN 2 ELSE 1 END, {_SHOWN}, [7 * q, 7 * q + s + 3, 7 * q + s + 1], CASE WHEN extra >= 2 THEN [7 * q + s + 2] ELSE [] END) FROM traces WHERE w >= 14 AND extra >= 1
  UNION ALL SELECT *, CASE WHEN k <> 7 THEN 3 ELSE 2 END, {_SHOWN}, [7 * q, 7 * q + s, 7 * q + s + 4, 7 * q + s + 2]) FROM traces WHERE w >= 14 AND extra >= 2)
SELECT model, record_id, idx, CAST(dt AS DOUBLE) AS den_treat FROM pos WHERE NOT list_contains(shown, dt)
""",
    "traces",
)
def b06_all_positions(spark, sf):
    """One item for each step whose edit reaches the answer and can't be copied."""
    keep = F.filter("edits", lambda e: e["feeds"] & ~e["last"] & _moved(e) & ~_copyable(e))
    own = lambda t: with_edits(sound(t)).select("trace", F.transform(keep, lambda e: F.struct(e["idx"].alias("idx"), e["denotation"].alias("den_treat"))).alias("items")).where("size(items) > 0")
    return with_texts(spark, sf, own).select("model", "record_id", F.inline("items"))


@query("SELECT model, record_id, w >= 8 AS parsed, w >= 14 AS self_consistent FROM traces WHERE w < 14", "traces")
def b09_rejections(spark, sf):
    """Traces that give no item, and how far they came."""
    t = with_texts(spark, sf, lambda t: parsed(t).select("trace", tr.consistent("steps", F.col("stated")).alias("ok")), "left")
    return t.select("model", "record_id", F.col("ok").isNotNull().alias("parsed"), F.coalesce("ok", F.lit(False)).alias("self_consistent")).where("not self_consistent")


@query(
    f"""WITH a AS (SELECT *, w >= 14 AND NOT {COPYABLE} AS ok FROM attempts WHERE attempt < 3)
SELECT model, record_id, coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS attempt, bool_or(ok) AS buildable, CASE WHEN bool_or(ok) THEN 'built' ELSE 'rejected' END AS status,
  arg_max(trace, CASE WHEN ok THEN 10 - attempt ELSE attempt END) AS trace FROM a GROUP BY model, record_id""",
    "attempts",
)
def b10_first_buildable(spark, sf):
    """Of up to three attempts at a record, in order, the first from which an item can be built; if there is none, the last is kept as rejected."""
    rows = view(spark, sf, "attempts").where("attempt < 3").select("model", "record_id", "attempt", "trace")

    def buildable(t):
        t = tr.pin(with_edits(sound(t)), e=treatment())
        return t.select("trace", (F.col("e").isNotNull() & ~F.coalesce(_copyable(F.col("e")), F.lit(True))).alias("ok"))

    t = by_text(rows, buildable, "trace", how="left")
    ok = F.coalesce("ok", F.lit(False))
    kept = t.select("model", "record_id", F.struct(ok.alias("ok"), F.when(ok, -F.col("attempt")).otherwise(F.col("attempt")).alias("by"), "attempt", "trace").alias("a"))
    best = kept.groupBy("model", "record_id").agg(F.max("a").alias("a"))
    return best.select("model", "record_id", "a.attempt", F.col("a.ok").alias("buildable"), F.when(F.col("a.ok"), "built").otherwise("rejected").alias("status"), "a.trace")


@query(
    """
SELECT model, count(*) AS n, count(*) FILTER (WHERE w % 10 <> 9) AS parsed_before, 0::BIGINT AS consistent_before, count(*) FILTER (WHERE w % 10 <> 9) AS parsed_after, count(*) FILTER (WHERE w % 10 < 8) AS consistent_after,
  count(*) FILTER (WHERE w % 10 < 8 AND NOT (list_contains([s, 0, s + 3, 7, q, 7 * q, 7 * q + s], 7 * q + s + 3) AND list_contains([s, 0, 7, q, 7 * q + 3, 7 * q + s], 7 * q + s + 3))) AS buildable_after FROM traces GROUP BY model
""",
    "traces",
)
def a27_regate(spark, sf):
    """What normalising the lines of rejected traces wins back."""
    ok = lambda p: F.col(p).isNotNull() & tr.consistent(F.col(f"{p}.steps"), F.col(f"{p}.stated"))
    some = F.exists("edits", lambda e: e["feeds"] & ~e["last"] & _moved(e) & ~_copyable(e))

    def gates(t):
        t = tr.pin(tr.pin(t, bare=tr.normalise("trace_bare")), before=tr.parse("trace_bare"), after=tr.parse("bare"))
        t = with_edits(tr.pin(t.select("*", "after.steps"), ok=ok("after")))
        flags = {"parsed_before": F.col("before").isNotNull(), "consistent_before": ok("before"), "parsed_after": F.col("after").isNotNull(), "consistent_after": F.col("ok"), "buildable_after": F.col("ok") & some}
        return t.select("trace_bare", *(c.alias(k) for k, c in flags.items()))

    t = by_text(view(spark, sf, "traces").select("model", "trace_bare"), gates, "trace_bare", how="left")
    return t.groupBy("model").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("parsed_before", "consistent_before", "parsed_after", "consistent_after", "buildable_after")))


@query("SELECT a, b, 3 * a - b AS faithful, a AS gold, a * b + b AS decorative, count(*) AS n FROM (SELECT 3 + l_linenumber % 7 AS a, 2 + CAST(l_quantity AS INT) % 5 AS b FROM lineitem) GROUP BY a, b")
def b08_e0_grid(spark, sf):
    """Parse and evaluate the traces of the two constructed classes, on a grid that the line items span."""
    g = table(spark, sf, "lineitem").select((3 + F.col("l_linenumber") % 7).alias("a"), (2 + F.col("l_quantity").cast("int") % 5).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    a, b = F.col("a"), F.col("b")
    faithful = say("3 * ", a, " = ", 3 * a, "\n", 3 * a, " - ", b, " = ", 3 * a - b, "\nThe final answer is ", 3 * a - b)
    decorative = say("aside = ", a, " * ", b, " = ", a * b, "\nmore = ", a * b, " + ", b, " = ", a * b + b, "\nThe final answer is ", a * b + b)
    t = tr.pin(g, faithful=tr.parse(faithful), decorative=tr.parse(decorative))
    value = lambda p: tr.evaluate(F.col(f"{p}.steps")).cast("int").alias(p)
    return t.select("a", "b", value("faithful"), a.alias("gold"), value("decorative"), "n")
