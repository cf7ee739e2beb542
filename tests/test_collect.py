"""Filling in answers and seeds: what is asked, what is kept, and what a run that broke off leaves."""

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import trace as tr
from tracegrain.operators.collect import answer_pending, lacking, replicate, seed_coverage
from tracegrain.operators.panel import e0_metrics, roc_auc

RECORD = "model string, record_id string, status string, conditions map<string,string>, outputs map<string,string>, answers map<string,double>, said string"


def test_answer_pending(spark):
    text = {"legacy": "say 4", "treat": "x"}
    rows = [
        ("m", "due", "built", text, {"treat": "t"}, {"treat": 1.0, "legacy": None}, "other"),
        ("m", "due", "built", text, {"treat": "t"}, {"treat": 1.0, "legacy": 9.0}, "answered before"),
        ("m", "done", "built", text, {}, {"legacy": 2.0}, None),
        ("m", "no text", "built", {"treat": "x"}, {}, {}, None),
        ("m", "rejected", "unparsed", text, {}, {}, None),
        ("m", "fails", "built", {"legacy": "fail"}, None, None, None),
        ("m", "unclear", "built", {"legacy": "unclear"}, None, None, None),
        ("m", "twice", "built", {"legacy": "say 7"}, None, None, None),
        ("m", "twice", "built", {"legacy": "say 7"}, None, None, None),
        ("m", None, "built", text, None, None, None),
        ("m", "nothing", "built", None, None, None, None),
        (None, None, None, None, None, None, None),
    ]
    asked = []

    def ask(r):
        asked.append(sorted((x.record_id, x.prompt) for x in r.collect()))
        return r.withColumn("said", F.when(F.col("prompt") != "fail", F.regexp_replace("prompt", "say", "The answer is")))

    # A column named ``said`` of the caller's own would clash with the reply: it is renamed by whoever has one.
    t = spark.createDataFrame(rows, RECORD).withColumnRenamed("said", "note")
    got = answer_pending(t, ["model", "record_id"], "legacy", ask)
    assert asked == [[("due", "say 4"), ("fails", "fail"), ("twice", "say 7"), ("unclear", "unclear")]]
    got = sorted(((r.record_id, r.note, r.asked, r.outputs, r.answers) for r in got.collect()), key=repr)
    want = [
        ("due", "other", True, {"treat": "t", "legacy": "The answer is 4"}, {"treat": 1.0, "legacy": 4.0}),
        ("due", "answered before", False, {"treat": "t"}, {"treat": 1.0, "legacy": 9.0}),
        ("done", None, False, {}, {"legacy": 2.0}),
        ("no text", None, False, {}, {}),
        ("rejected", None, False, {}, {}),
        ("fails", None, True, None, None),
        ("unclear", None, True, {"legacy": "unclear"}, {"legacy": None}),
        ("twice", None, True, {"legacy": "The answer is 7"}, {"legacy": 7.0}),
        ("twice", None, True, {"legacy": "The answer is 7"}, {"legacy": 7.0}),
        (None, None, False, None, None),
        ("nothing", None, False, None, None),
        (None, None, False, None, None),
    ]
    assert got == sorted(want, key=repr)
    assert answer_pending(t.where("false"), ["model", "record_id"], "legacy", ask).count() == 0


KEYS = "model string, seed int, problem_id string"


def test_seed_coverage(spark):
    have = [("a", 1, "p"), ("a", 1, "p"), ("a", 1, "q"), ("a", 0, "p"), ("b", None, "p"), ("b", 2, None), (None, 1, "p")]
    got = {(r.model, r.seed): (r.n_problems, r.complete) for r in seed_coverage(spark.createDataFrame(have, KEYS), [1, 2], 2).collect()}
    # Repeated records count once, a record without a seed or problem not at all; a system without records of a seed is told of.
    assert got == {("a", 1): (2, True), ("a", 2): (0, False), ("b", 1): (0, False), ("b", 2): (0, False)}
    with pytest.raises(ValueError):
        seed_coverage(spark.createDataFrame(have, KEYS), [], 2)
    assert seed_coverage(spark.createDataFrame([], KEYS), [1], 2).count() == 0


def test_replicate(spark):
    panel = spark.createDataFrame([("p",), ("q",), ("q",), ("r",), (None,)], "problem_id string")
    have = spark.createDataFrame([("a", 1, "p", 1), ("a", 1, "q", 1), ("a", 2, "p", 1), ("a", 2, "q", 1), ("a", 2, "r", 1), ("b", 0, "p", 1)], f"{KEYS}, n int")
    assert sorted(tuple(r) for r in lacking(have, panel, [1, 2]).collect()) == [("a", 1, "r"), ("b", 1, "p"), ("b", 1, "q"), ("b", 1, "r"), ("b", 2, "p"), ("b", 2, "q"), ("b", 2, "r")]
    sent = []

    def ask(todo, i):
        sent.append((i, todo.count()))
        # Problem q fails in the first round.
        return todo.where((F.col("problem_id") != "q") | (F.lit(i) > 1)).withColumn("n", F.lit(i))

    all_, log = replicate(have, panel, [1, 2], ask)
    assert sent == [(1, 7), (2, 2)]
    assert all_.groupBy("model", "seed", "problem_id").count().where("count > 1").count() == 0 and all_.count() == 6 + 7
    got = {(r.round, r.model, r.seed): (r.n_sent, r.n_problems, r.complete) for r in log.collect()}
    assert got == {
        (1, "a", 1): (1, 3, True), (1, "a", 2): (0, 3, True), (1, "b", 1): (3, 2, False), (1, "b", 2): (3, 2, False),
        (2, "a", 1): (0, 3, True), (2, "a", 2): (0, 3, True), (2, "b", 1): (1, 3, True), (2, "b", 2): (1, 3, True),
    }
    # A run that is repeated sends nothing.
    again, log = replicate(all_, panel, [1, 2], ask)
    assert len(sent) == 2 and again.count() == all_.count() and {(r.round, r.n_sent, r.complete) for r in log.collect()} == {(0, 0, True)}


def test_e0_metrics(spark):
    nan = float("nan")
    rows = [(1.0, 5.0, 5.0), (1.0, 5.0, 1.0), (1.0, 5.0, 1.0 + 1e-10), (1.0, 5.0, 7.0), (1.0, 5.0, None), (1.0, 5.0, nan), (1.0, None, 5.0), (None, 5.0, 5.0), (3.0, 3.0, 3.0)]
    t = e0_metrics(spark.createDataFrame(rows, "gold double, denotation double, answer double"))
    got = [(r.follow_denotation, r.question_correct, r.change_from_gold) for r in t.collect()]
    assert got == [(1, 0, 1), (0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 1, 0)]


def test_e0_reader_of_traces(spark):
    # Who follows every trace follows both classes: only whether the question was met tells them apart.
    rows = [(1, 3.0 * a - b, 3.0 * a - b) for a in range(3, 9) for b in range(2, 6)] + [(0, float(a), float(a * b + b)) for a in range(3, 9) for b in range(2, 6)]
    t = e0_metrics(spark.createDataFrame([(y, g, d, d) for y, g, d in rows], "label int, gold double, denotation double, answer double"))
    t = t.unpivot(["label"], ["follow_denotation", "question_correct", "change_from_gold"], "metric", "score")
    assert {r.metric: r.auc for r in roc_auc(t, "metric", "score", "label").collect()} == {"follow_denotation": 0.5, "question_correct": 1.0, "change_from_gold": 0.0}


def test_probes(spark):
    step = "struct<lhs string, op string, rhs string>"
    t = spark.createDataFrame([("a = 2 * 3 = 9", ("2", "*", "3"), 9.0), ("", ("x", "+", "0.5"), 2.5), (None, ("2", "*", "3"), None)], f"edited string, step {step}, value double")
    got = [r[0] for r in t.select(tr.competence_probe(F.col("edited"), tr.residual_probe(F.col("step"), F.col("value")))).collect()]
    head = "Read this arithmetic and report the final numeric result.\n"
    assert got == [head + "a = 2 * 3 = 9", head + "Compute the result if x + 0.5 were 2.5 and the remaining steps were applied.", head]


def test_numbers_without_text(spark):
    t = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), float("-inf"), 2.5)], "v double")
    assert [r[0] for r in t.select(tr.number_text(F.col("v"))).collect()] == [None, None, None, None, "2.5"]
