"""Parsing, evaluating and editing traces."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tracegrain.functions import trace as tr
from tracegrain.plans.queries import QUERIES
from tracegrain.plans.trace_queries import _copyable, edited_values, placebo, treatment, with_edits

# Fixed value: the canonical trace.
TRACE = "cost = 3 * 7 = 21\naside = 4 * 2 = 8\ntotal = cost + 5 = 26\nThe final answer is 26"


def steps_of(spark, text):
    t = tr.pin(spark.createDataFrame([(text,)], "text string"), p=tr.parse("text"))
    return t.select("text", "p", "p.steps", "p.stated")


def one(df, *cols):
    return df.select(*cols).first()


def test_canonical(spark):
    t = steps_of(spark, TRACE)
    r = one(t, tr.evaluate("steps"), tr.consistent("steps", F.col("stated")), F.array_sort(tr.feeding("steps")), tr.render("steps"))
    assert r[0] == 26 and r[1] and r[2] == [0, 2]
    assert r[3] == "cost = 3 * 7 = 21\naside = 4 * 2 = 8\ntotal = cost + 5 = 26"


def test_edits(spark):
    t = tr.pin(with_edits(steps_of(spark, TRACE)), e=treatment(), pl=placebo(), cp=F.element_at("edits", -1))
    r = one(t, "e.idx", "e.denotation", _copyable(F.col("e")), "pl.idx", "pl.denotation", _copyable(F.col("cp")))
    assert tuple(r) == (0, 29.0, False, 1, 26.0, True)


@pytest.mark.parametrize(
    "text,value",
    [
        ("x = 2 + 3 = 5\ny = z + 1 = 9", None),
        ("x = 4 / 0 = 0", None),
        ("x = 2 + 3 = 5\nx = x + 1 = 6\ny = x * 2 = 12", 12),
        ("x = - 3 = -3", None),
        (".5 + 1 = 1.5", None),
        ("answer = 40 * 2 = 80\nx = 1 + 1 = 2", 2),
        ("prose only", None),
        ("", None),
        (None, None),
        ("a = 1.5 * 2 = 3\r\nb = a + 0.25 = 3.25", 3.25),
    ],
)
def test_values(spark, text, value):
    assert one(steps_of(spark, text), tr.evaluate("steps"))[0] == value


def test_cycle_and_last_binding(spark):
    r = one(steps_of(spark, "x = x + 1 = 5\ny = 2 + 2 = 4\nz = x + 1 = 6"), F.array_sort(tr.feeding("steps")))
    assert r[0] == [0, 2]


@pytest.mark.parametrize("text,value", [("The final answer is $42", 42), (r"so \boxed{ 7 }", 7), ("note\n 12 \nend 3", 12), ("it is 3 or -4.5", -4.5), ("none", None), (None, None)])
def test_extract(spark, text, value):
    assert one(spark.createDataFrame([(text,)], "t string"), tr.extract_answer("t"))[0] == value


@pytest.mark.parametrize("line,want", [("n = 5", "n = 5 + 0 = 5"), ("v = a * b = 3 * 4 = 12", "v = 3 * 4 = 12"), ("v = 3 * 4 = 12", "v = 3 * 4 = 12"), ("Just prose.", "Just prose."), ("The answer is 5", "The answer is 5")])
def test_normalise(spark, line, want):
    assert one(spark.createDataFrame([(line,), (want,)], "t string"), tr.normalise("t"))[0] == want


@pytest.mark.parametrize("value,want", [(3.0, "3"), (-2.0, "-2"), (0.24, "0.24"), (1.5, "1.5"), (2 / 3, "0.666667")])
def test_number_text(spark, value, want):
    assert one(spark.createDataFrame([(value,)], "v double"), tr.number_text(F.col("v")))[0] == want


def test_asserts():
    """One call of a plain name on literals compared with a literal; everything else is no test."""
    from tracegrain.functions.asserts import parse_call

    assert parse_call(" assert f(1, 'a', [2, (3,)]) == {'k': -1.5} ") == {"name": "f", "args": ["1", "'a'", "[2, (3,)]"], "expected": "{'k': -1.5}"}
    assert parse_call("assert f() == None") == {"name": "f", "args": [], "expected": "None"}
    bad = [None, "", "f(1) == 2", "assert f(x) == 2", "assert f(1) == g(2)", "assert f(1) != 2", "assert f(1) == 2 == 3", "assert a.f(1) == 2", "assert f(k=1) == 2", "assert f(*a) == 2", "assert f(1", "assert f(1) == 2; x = 1", "assert (" * 500, "assert set(f(1)) == 2", "assert f({[]: 1}) == 2"]
    assert [parse_call(x) for x in bad] == [None] * len(bad)


BY_TEXT = "a10_placebo_derail a27_regate b01_treatment b02_placebo b03_copyable b05_build_items b06_all_positions b07_competence b09_rejections b10_first_buildable p01_parse_steps p02_first_step p04_evaluate p05_consistent p06_feeds p07_literals p08_render p10_evaluate_edited p18_edit_distance p20_judge_prompt"


@pytest.mark.parametrize("name", BY_TEXT.split())
def test_texts_are_parsed_once(spark, name):
    """The rows meet what was found in their text; no row is parsed by itself."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "([-+*/])" not in plan


def test_number_text_in_the_middle(spark):
    """Seven digits that end in 5: the double itself decides, and where it is the middle, the even digit (as Python's and C's %g)."""
    import random

    rng = random.Random(9)
    values = [49999.75, 1.000005, 1.000015, 0.5000025, 123456.5, 123457.5, -31249.75, 999999.5, 9.999995, 9.9999949999, 0.1, 1 / 7, 1e-9 / 4, 4999975e-16]
    values += [s * rng.randrange(100_000, 1_000_000) * 10 ** -e for e in range(1, 6) for s in (1, -1)]
    values += [float(f"{rng.choice('-+')}{rng.randrange(100_000, 1_000_000)}5e{-rng.randrange(1, 21)}") for _ in range(3000)]
    values += [rng.randrange(1, 2**24) / 2 ** rng.randrange(1, 20) for _ in range(2000)] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 6) for _ in range(500)]
    values = [v for v in values if v != int(v)]
    got = spark.createDataFrame([(v,) for v in values], "v double").repartition(3).select("v", tr.number_text(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t, f"{r.v:g}") for r in got if r.t != f"{r.v:g}"] == []


def test_edited_value_is_worked_out_once(spark):
    """Its text looks at the value many times."""
    t = edited_values(spark.createDataFrame([(TRACE,)], "trace string"))
    assert t._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2
    assert [r.value for r in t.collect()] == ["29"]
