"""Reasoning traces as columns: parsing, evaluation, dependency, edits. Built-in functions only.

A trace is text with one step a line, ``name = lhs op rhs = value``, and a line that states the answer. ``parse`` gives
an array of steps; everything after works on that array with higher-order functions, so a trace never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line formats of a trace.
STEP = r"^\s*(?:([A-Za-z_][A-Za-z_0-9 ]*?)\s*=\s*)?([A-Za-z_0-9. ]+?)\s*([-+*/])\s*([A-Za-z_0-9. ]+?)\s*=\s*(-?\d+(?:\.\d+)?)\s*$"
ANSWER = r"(?i)(?:final answer|answer)\s*(?:is|:|=)\s*(-?\d+(?:\.\d+)?)"
NUMBER = r"^-?\d+(?:\.\d+)?$"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
BARE = r"^\s*([A-Za-z_][A-Za-z_0-9 ]*?)\s*=\s*(-?\d+(?:\.\d+)?)\s*$"
TAIL = r"^\s*(?:([A-Za-z_][A-Za-z_0-9 ]*?)\s*=\s*)?.*?(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*=\s*(-?\d+(?:\.\d+)?)\s*$"
ANSWER_FORMS = (r"(?i)(?:final answer|answer)\s*(?:is|:|=)\s*\$?(-?\d+(?:\.\d+)?)", r"\\boxed\{\s*(-?\d+(?:\.\d+)?)\s*\}", r"(?m)^\s*(-?\d+(?:\.\d+)?)\s*$")

BOX = r"\\boxed\{([^{}]+)\}"
FRACTION = r"^\\?frac\{(-?\d+)\}\{(\d+)\}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pin(rows, **columns: Column):
    """Adds columns that are computed once for each row.

    The optimiser merges a projection into what reads it; inside a higher-order function a merged expression would run again for every
    element. A generator of one row can't be merged."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def lines(text) -> Column:
    """The lines that are not blank."""
    return F.filter(F.split(_c(text), LINE_BREAK), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")


def _empty_null(x: Column) -> Column:
    return F.when(x != "", x)


def parse(text) -> Column:
    """struct(steps, stated): steps is an array of (idx, name, lhs, op, rhs, value, a, b, a_at, b_at, a_from, b_from); null if there is no step.

    a and b are the operands' values if they are numbers; a_at and b_at the last earlier step that binds their names, a_from and
    b_from the last step of all that does. Names are looked up here, once, so that evaluation and edits go by position.
    A line that states an answer is never a step; the last such line counts."""
    kept = lines(text)
    group = lambda line, i: F.regexp_extract(line, STEP, i)
    parts = F.transform(
        F.filter(kept, lambda x: ~x.rlike(ANSWER) & x.rlike(STEP)),
        lambda x, i: F.struct(i.alias("idx"), _empty_null(F.trim(group(x, 1))).alias("name"), F.trim(group(x, 2)).alias("lhs"), group(x, 3).alias("op"), F.trim(group(x, 4)).alias("rhs"), group(x, 5).cast("double").alias("value")),
    )
    number = lambda t: F.when(t.rlike(NUMBER), t).cast("double")

    def bound(steps, token, before=None):
        own = F.filter(steps, lambda t: (t["name"] == token) & (F.lit(True) if before is None else t["idx"] < before))
        return F.try_element_at(own, F.lit(-1))["idx"]

    def resolved(steps):
        keep = ("idx", "name", "lhs", "op", "rhs", "value")
        at = lambda s, c, k: (number(s[c]).alias(k), bound(steps, s[c], s["idx"]).alias(f"{k}_at"), bound(steps, s[c]).alias(f"{k}_from"))
        return F.transform(steps, lambda s: F.struct(*(s[c].alias(c) for c in keep), *at(s, "lhs", "a"), *at(s, "rhs", "b")))

    # As a lambda's argument the steps are made once, however often they are looked at.
    found = F.transform(F.array(parts), resolved)[0]
    said = F.filter(kept, lambda x: x.rlike(ANSWER))
    stated = F.when(F.size(said) > 0, F.regexp_extract(F.element_at(said, -1), ANSWER, 1).cast("double"))
    return F.transform(F.array(F.struct(found.alias("steps"), stated.alias("stated"))), lambda p: F.when(F.size(p["steps"]) > 0, p))[0]


def evaluate(steps, edit_idx=None, edit_value=None) -> Column:
    """The value that the steps compute, in order; an edited step has the value it is given. Null once an operand is unknown."""
    steps = _c(steps)
    edit_idx = F.lit(None).cast("int") if edit_idx is None else _c(edit_idx)
    edit_value = F.lit(None).cast("double") if edit_value is None else _c(edit_value)
    start = F.struct(F.array().cast("array<double>").alias("values"), F.lit(True).alias("ok"))

    def step(acc, s):
        a = F.coalesce(s["a"], F.get(acc["values"], s["a_at"]))
        b = F.coalesce(s["b"], F.get(acc["values"], s["b_at"]))
        made = F.when(s["op"] == "+", a + b).when(s["op"] == "-", a - b).when(s["op"] == "*", a * b).otherwise(F.try_divide(a, b))
        value = F.when(s["idx"].eqNullSafe(edit_idx), edit_value).otherwise(made)
        values = F.concat(acc["values"], F.array(value))
        return F.struct(values.alias("values"), (acc["ok"] & F.element_at(values, -1).isNotNull()).alias("ok"))

    return F.aggregate(steps, start, step, lambda acc: F.when(acc["ok"], F.try_element_at(acc["values"], F.lit(-1))))


def consistent(steps, stated) -> Column:
    d, stated = evaluate(steps), _c(stated)
    return F.coalesce(F.abs(d - stated) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(stated)), F.lit(False))


def feeding(steps) -> Column:
    """Indices of the steps that the last step depends on, itself included: a fixpoint, one pass for each step.

    The producer of a name is the last step that binds it."""
    steps = _c(steps)

    def more(need, _):
        found = F.flatten(F.transform(need, lambda i: F.array(F.get(steps, i)["a_from"], F.get(steps, i)["b_from"])))
        return F.array_union(need, F.array_compact(found))

    return F.aggregate(F.sequence(F.lit(1), F.size(steps)), F.array(F.element_at(steps, -1)["idx"]), more)


def literals(steps, edit_idx=None, edit_value=None) -> Column:
    """Every number that the text of the (edited) trace shows."""
    edit_idx = F.lit(None).cast("int") if edit_idx is None else _c(edit_idx)
    edit_value = F.lit(None).cast("double") if edit_value is None else _c(edit_value)
    shown = lambda s: F.when(s["idx"].eqNullSafe(edit_idx), edit_value).otherwise(s["value"])
    return F.array_compact(F.flatten(F.transform(_c(steps), lambda s: F.array(s["a"], s["b"], shown(s)))))


def copyable(target, shown: Column) -> Column:
    target = _c(target)
    return F.exists(shown, lambda x: F.abs(target - x) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(target)))


def _off_the_middle(value: Column) -> Column:
    """A number halfway between two of six digits, as far as its decimal text shows, becomes the one of them that lies nearer to the double itself, or ends in
    an even digit if none does; all others stay. Powers of ten are exact up to 22, so numbers below 1e-16 stay too."""
    ten = lambda k: F.concat(F.lit("1e"), k.cast("string")).cast("double")
    given = lambda x, f: F.transform(F.array(x), f)[0]
    size = F.abs(value)

    def halves(x):
        hi = x * 134217729.0 - (x * 134217729.0 - x)
        return hi, x - hi

    def settled(s):
        p, m = s["v"] * s["ten"], F.round(s["v"] * s["ten"])
        (vh, vl), (th, tl) = halves(s["v"]), halves(s["ten"])
        # What the product p loses to rounding, exactly.
        side = (p - m) + (((vh * th - p) + vh * tl + vl * th) + vl * tl)
        low = F.floor(m / 10)
        near = (low + F.when((side > 0) | ((side == 0) & (low % 2 == 1)), 1).otherwise(0)) / s["tenth"]
        return F.when((m % 10 == 5) & (F.abs(p - m) < 0.01), near).otherwise(s["v"])

    power = F.regexp_extract(F.format_string("%.16e", size), r"e([-+]\d+)$", 1).try_cast("int")
    moved = given(F.struct(size.alias("v"), ten(6 - power).alias("ten"), ten(5 - power).alias("tenth")), settled)
    return F.when((size >= 1e-16) & (size < 1e6), F.when(value < 0, -moved).otherwise(moved)).otherwise(value)


def number_text(value: Column) -> Column:
    """A number as a trace shows it: whole numbers without a point; others with six significant digits and no trailing zeros,
    with an exponent of two digits or more below 1e-4 and from 1e6 on; the nearest such number, of two at the same distance the one with an even last digit.
    (Below 1e-16, of two at the same decimal distance the larger.) What is missing, infinite or no number has no text."""
    value = F.when(F.abs(value) < float("inf"), value)
    shown = F.format_string("%.5e", F.when(value != F.floor(value), _off_the_middle(value)))
    power = F.regexp_extract(shown, r"e([-+]\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(shown, r"^-?([\d.]+)e", 1), r"\.", "")
    zeros = F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0)))
    plain = F.when(power < 0, F.concat(F.lit("0."), zeros, digits)).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6))))
    trim = lambda x: F.regexp_replace(x, r"\.?0*$", "")
    small = F.concat(trim(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.regexp_extract(shown, r"(e.*)$", 1))
    text = F.concat(F.when(value < 0, "-").otherwise(""), F.when(power.between(-4, 5), trim(plain)).otherwise(small))
    whole = F.when(F.abs(value) < 9e18, value.cast("bigint").cast("string")).otherwise(value.cast("decimal(38,0)").cast("string"))
    return F.when(value == F.floor(value), whole).when(value.isNotNull(), text)


def render(steps, edit_idx=None, edit_value=None) -> Column:
    """The trace's text with the edited value in place, without the answer line."""
    edit_idx = F.lit(None).cast("int") if edit_idx is None else _c(edit_idx)
    edit_value = F.lit(None).cast("double") if edit_value is None else _c(edit_value)

    def line(s):
        value = F.when(s["idx"].eqNullSafe(edit_idx), edit_value).otherwise(s["value"])
        return F.concat(F.coalesce(F.concat(s["name"], F.lit(" = ")), F.lit("")), s["lhs"], F.lit(" "), s["op"], F.lit(" "), s["rhs"], F.lit(" = "), number_text(value))

    return F.array_join(F.transform(_c(steps), line), "\n")


def extract_answer(text) -> Column:
    """The stated answer, else a boxed one, else a line that is a number, else the last number."""
    text = _c(text)
    tries = [_empty_null(F.regexp_extract(text, form, 1)) for form in ANSWER_FORMS]
    numbers = F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), 0)
    return F.coalesce(*tries, F.try_element_at(numbers, F.lit(-1))).cast("double")


# The two texts that ask for an edited trace's result.
def residual_probe(step: Column, value: Column) -> Column:
    """What would come out if this step had another value."""
    return F.concat(F.lit("Compute the result if "), step["lhs"], F.lit(" "), step["op"], F.lit(" "), step["rhs"], F.lit(" were "), number_text(value), F.lit(" and the remaining steps were applied."))


def competence_probe(edited: Column, residual: Column) -> Column:
    """The edited trace to be read by itself; where there is none, the residual question."""
    shown = F.coalesce(F.when(edited != "", edited), residual, F.lit(""))
    return F.concat(F.lit("Read this arithmetic and report the final numeric result.\n"), shown)


def last_line(text: Column) -> Column:
    """The last line, also if it is blank; a break at the end opens no line."""
    return F.element_at(F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})$", ""), LINE_BREAK), -1)


def math_answer(text) -> Column:
    """The number in the last box, else that of the last line: decimal, or a LaTeX fraction of whole numbers; null for anything else."""
    text = _c(text)
    boxes = F.regexp_extract_all(text, F.lit(BOX), 1)
    said = F.when(F.size(boxes) > 0, F.element_at(boxes, -1)).otherwise(last_line(text))
    said = F.regexp_replace(F.regexp_replace(said, "[,$]", ""), r"^\s+|\s+$", "")
    top, bottom = (_empty_null(F.regexp_extract(said, FRACTION, i)).cast("double") for i in (1, 2))
    return F.when(said.rlike(NUMBER), F.when(said.rlike(NUMBER), said).cast("double")).otherwise(F.try_divide(top, bottom))


def normalise_line(line: Column) -> Column:
    """Rewrites ``name = c`` and chains of equations into steps; all else stays."""
    name = F.regexp_extract(line, TAIL, 1)
    value = F.regexp_extract(line, BARE, 2)
    tail = F.concat(F.when(name != "", F.concat(name, F.lit(" = "))).otherwise(""), F.regexp_extract(line, TAIL, 2), F.lit(" "), F.regexp_extract(line, TAIL, 3), F.lit(" "), F.regexp_extract(line, TAIL, 4), F.lit(" = "), F.regexp_extract(line, TAIL, 5))
    return F.when(line.rlike(STEP) | line.rlike(ANSWER), line).when(line.rlike(BARE), F.concat(F.regexp_extract(line, BARE, 1), F.lit(" = "), value, F.lit(" + 0 = "), value)).when(line.rlike(TAIL), tail).otherwise(line)


def normalise(text) -> Column:
    return F.array_join(F.transform(F.split(_c(text), LINE_BREAK), normalise_line), "\n")
