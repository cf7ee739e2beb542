"""Programs, tests and stated results."""

import pytest

from tracegrain.operators import codedom as c


def test_read_test():
    assert c.read_test("assert f(1, [2, 3]) == -4") == ("f", [1, [2, 3]], -4)
    for bad in ("assert f(x) == 1", "f(1) == 2", "assert f(1) > 2", "assert f(a=1) == 2", "assert", ""):
        assert c.read_test(bad) is None


def test_early_return():
    f = c.read_function("text\n```python\ndef f(x):\n    y = x - 2\n    if y > 0:\n        return 5\n    return -1\n```")
    assert c.tail(f.body, {"x": 4}) == 5 and c.tail(f.body, {"x": 1}) == -1


def test_item():
    got = c.build("def g(x):\n    y = 2\n    z = x * 2\n    return z + y\n", "assert g(3) == 8")
    assert (got["den_clean"], got["den_treat"], got["edited"]) == (8, 14, "x")
    later = c.build("def g(x):\n    y = x + 1\n    return y * 10\n", "assert g(1) == 20")
    assert later["den_treat"] == 50


@pytest.mark.parametrize("source", ["def g(x):\n    import os\n    return 1", "def g(x):\n    while True:\n        x = 1\n    return x", "def g(x):\n    y = [0] * 10000000\n    return 1", "def g(x):\n    y = 9\n    while x < 90:\n        y *= y\n        x += 1\n    return 1", "x = 1", "def g(x:", "def g(x):\n    y = x.real\n    return y"])
def test_nothing_else_is_evaluated(source):
    assert "den_clean" not in c.build(source, "assert g(1) == 1")


def test_loop_and_rest():
    got = c.build("def g(n):\n    s = 0\n    for i in range(n):\n        if i % 2:\n            s += i\n    t = s + n\n    return t", "assert g(4) == 8")
    assert (got["den_clean"], got["den_treat"], got["edited"]) == (8, 16, "n")
    assert got["rest"].splitlines() == ["s = 0", "for i in range(n):", "    if i % 2:", "        s += i", "t = s + n", "return t"]


def test_edits():
    assert [c.edited(v) for v in (True, 2, 0.5, "a", [1, 2])] == [False, 5, 3.5, "a_x", [4, 2]]
    assert [c.edited(v) for v in ("", [], [True], [1.5], None, {})] == [None] * 6


def test_stated(spark):
    replies = ["Result: foo\nThe answer is [1, 2].", "thinking\n42", "nothing here", None, "", "answer = 'a'.\nfinal result is 3..", "Result: 1\nresult: x\n  (2, 3)  \n"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i long, text string")
    got = {r.i: r.a for r in t.select("i", c.stated_json(t.text).alias("a")).collect()}
    assert [got[i] for i in range(len(replies))] == ["[1, 2]", "42", None, None, None, "3", "1"]


@pytest.mark.parametrize("name", ["c01_code_survival", "c08_build_code_items", "c10_code_prompt", "s09_first_test"])
def test_programs_are_read_once(spark, name):
    """No row is read with Python's grammar by itself: rows meet what was found in their text."""
    from conftest import SF

    from tracegrain.plans.queries import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "EvalPython" not in plan
