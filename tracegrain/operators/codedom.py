"""Items from short programs: state and rest of a function at a resume point, and what an edited state makes of it.

Programs are read, never run: a small evaluator walks the syntax tree of assignments, branches, loops, returns and arithmetic, with
bounds on its steps and on the size of values, and gives up on anything else. So no sandbox is needed; imports, attributes and
methods have no value. What lies around it (choosing among replies, counting, prompts) is Spark SQL.
"""

from __future__ import annotations

import ast
import json
import operator
import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_CALLS = {"abs": abs, "len": len, "min": min, "max": max, "sum": sum, "sorted": sorted, "int": int, "str": str, "range": lambda *a: _bounded(range(*a))}
#: Statements that one evaluation may take, and the size of a value: items, characters, or bits of a whole number.
STEPS, SIZE = 2000, 10_000

# How a state's value is edited, by its type; other values are not.
EDITS = {bool: lambda v: not v, int: lambda v: v + 3, float: lambda v: v + 3.0, str: lambda v: v + "_x", list: lambda v: [v[0] + 3, *v[1:]]}
# Fixed value: how a reply labels its result.
RESULT = r"(?im)(?:final result|result|answer)\s*(?:is|:|=)\s*(.+)$"


class Unknown(Exception):
    """The evaluator has no value for this."""


_FAILS = (Unknown, ArithmeticError, TypeError, LookupError, ValueError, RecursionError)


def _bounded(value):
    size = value.bit_length() if isinstance(value, int) else len(value) if hasattr(value, "__len__") else 0
    if size > SIZE:
        raise Unknown
    return value


def _product(a, b):
    """Not even made if it would be too large: a text or list times a number, or two long numbers."""
    for x, y in ((a, b), (b, a)):
        if isinstance(x, str | list) and isinstance(y, int) and len(x) * y > SIZE:
            raise Unknown
    return a * b


def _value(node: ast.expr, env: dict):
    match node:
        case ast.Constant():
            return node.value
        case ast.Name() if node.id in env:
            return env[node.id]
        case ast.List() | ast.Tuple():
            return [_value(x, env) for x in node.elts]
        case ast.UnaryOp(op=ast.USub()):
            return -_value(node.operand, env)
        case ast.UnaryOp(op=ast.Not()):
            return not _value(node.operand, env)
        case ast.BoolOp():
            held = [bool(_value(x, env)) for x in node.values]
            return all(held) if isinstance(node.op, ast.And) else any(held)
        case ast.BinOp() if type(node.op) in _BINARY:
            return _apply(node.op, _value(node.left, env), _value(node.right, env))
        case ast.Compare() if len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](_value(node.left, env), _value(node.comparators[0], env))
        case ast.Subscript():
            return _value(node.value, env)[_value(node.slice, env)]
        case ast.Call(func=ast.Name()) if node.func.id in _CALLS and not node.keywords:
            return _bounded(_CALLS[node.func.id](*(_value(a, env) for a in node.args)))
    raise Unknown


def _apply(op: ast.operator, a, b):
    if type(op) not in _BINARY:
        raise Unknown
    return _bounded(_product(a, b) if isinstance(op, ast.Mult) else _BINARY[type(op)](a, b))


def _run(body: list[ast.stmt], env: dict, budget: list[int]):
    """(returned, value) of some statements; assignments go to env."""
    for s in body:
        budget[0] -= 1
        if budget[0] < 0:
            raise Unknown
        match s:
            case ast.Assign(targets=[ast.Name() as t]):
                env[t.id] = _value(s.value, env)
            case ast.AugAssign(target=ast.Name() as t):
                env[t.id] = _apply(s.op, env[t.id], _value(s.value, env))
            case ast.Return():
                return True, None if s.value is None else _value(s.value, env)
            case ast.If():
                done, value = _run(s.body if _value(s.test, env) else s.orelse, env, budget)
                if done:
                    return True, value
            case ast.For(target=ast.Name() as t, orelse=[]):
                for x in _value(s.iter, env):
                    env[t.id] = x
                    done, value = _run(s.body, env, budget)
                    if done:
                        return True, value
            case ast.While(orelse=[]):
                while _value(s.test, env):
                    done, value = _run(s.body, env, budget)
                    if done:
                        return True, value
            case ast.Pass():
                pass
            case _:
                raise Unknown
    return False, None


def _copied(state: dict) -> dict:
    return {k: list(v) if isinstance(v, list) else v for k, v in state.items()}


def tail(body: list[ast.stmt], state: dict):
    """What the rest of a function returns from this state; None if it can't be told."""
    try:
        return _run(body, _copied(state), [STEPS])[1]
    except _FAILS:
        return None


def read_test(text: str):
    """(function, arguments, expected) of a test that compares one call on literals with a literal."""
    try:
        match ast.parse(text.strip()).body:
            case [ast.Assert(test=ast.Compare(left=ast.Call(func=ast.Name(id=name), args=args, keywords=[]), ops=[ast.Eq()], comparators=[wanted]))]:
                return name, *map(ast.literal_eval, (ast.List(args, ast.Load()), wanted))
    except (SyntaxError, ValueError, TypeError):
        pass
    return None


def source_of(text: str) -> str:
    """The program in a reply: what its code fence holds, from the first definition on."""
    fence = re.search(r"```(?:python)?\s*\n(.*?)```", text, re.S)
    body = fence[1] if fence else text
    at = re.search(r"^def ", body, re.M)
    return body[at.start() :] if at else body


def read_function(text: str) -> ast.FunctionDef | None:
    """The one function of a text."""
    try:
        defs = [x for x in ast.parse(source_of(text)).body if isinstance(x, ast.FunctionDef)]
    except (SyntaxError, ValueError):
        return None
    return defs[0] if len(defs) == 1 else None


def edited(value):
    """The edit for a value of this type, None without one; empty texts and lists of anything but whole numbers have none."""
    if isinstance(value, str | list) and not value or isinstance(value, list) and {type(v) for v in value} != {int}:
        return None
    edit = EDITS.get(type(value))
    return edit(value) if edit else None


def _is_number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def literals(body: list[ast.stmt]) -> list:
    return [n.value for n in ast.walk(ast.Module(body, [])) if isinstance(n, ast.Constant)]


def shown_in(target, body: list[ast.stmt]) -> bool:
    """Whether a value can be copied from a literal of the program's rest."""
    if _is_number(target):
        return any(abs(target - x) <= 1e-9 * max(1.0, abs(target)) for x in literals(body) if _is_number(x))
    return any(type(x) is type(target) and x == target for x in literals(body))


def build(source: str | None, test: str | None) -> dict:
    """``parsed``, and if an item can be made its fields: the first resume point with an edit that changes the result to a value no literal shows."""
    f, call = read_function(source or ""), read_test(test or "")
    out = {"parsed": f is not None}
    if f is None or call is None or len(f.args.args) != len(call[1]):
        return out
    start = {a.arg: v for a, v in zip(f.args.args, call[1], strict=True)}
    clean = tail(f.body, start)
    if clean is None or clean != call[2]:
        return out
    lines = source_of(source).splitlines()
    for i, s in enumerate(f.body[:-1]):
        if not isinstance(s, ast.Assign):
            continue
        state = _copied(start)
        try:
            if _run(f.body[:i], state, [STEPS])[0]:
                return out
        except _FAILS:
            return out
        rest, edits = f.body[i:], {k: e for k, v in state.items() if (e := edited(v)) is not None}
        made = {k: tail(rest, state | {k: e}) for k, e in edits.items()}
        treat = next((k for k, v in made.items() if v is not None and v != clean and not shown_in(v, rest)), None)
        if treat is None:
            continue
        placebo = next((k for k, v in made.items() if k != treat and v == clean), None)
        numbers, literal = [k for k, v in state.items() if _is_number(v)], next(filter(_is_number, literals(rest)), None)
        copied = tail(rest, state | {numbers[-1]: literal}) if numbers and literal is not None else None
        text = textwrap.dedent("\n".join(lines[s.lineno - 1 : f.body[-1].end_lineno]))
        out |= {"den_clean": clean, "den_treat": made[treat], "den_copyable": copied, "edited": treat, "placebo": placebo, "resume_line": s.lineno, "length": len(f.body), "state": state | {treat: edits[treat]}, "rest": text}
        break
    return out


@F.pandas_udf(StringType())
def build_json(source: pd.Series, test: pd.Series) -> pd.Series:
    """What ``build`` finds, as JSON, so that values of any type compare as canonical text."""
    return pd.Series([json.dumps(build(s, t)) for s, t in zip(source, test, strict=True)], dtype=object)


def literal(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(StringType())
def first_literal(tries: pd.Series) -> pd.Series:
    """The first of these texts that is a Python literal, as JSON."""
    found = (next((v for t in own if (v := literal(t)) is not None), None) for own in (() if x is None else x for x in tries))
    return pd.Series([None if v is None else json.dumps(list(v) if isinstance(v, tuple) else v, default=str) for v in found], dtype=object)


def stated_json(text: Column) -> Column:
    """The last labelled literal of a reply, else its last line if that is one."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    said = F.transform(F.reverse(F.regexp_extract_all(text, F.lit(RESULT), 1)), lambda x: F.regexp_replace(bare(x), r"\.+$", ""))
    last = bare(F.regexp_extract(bare(text), r"([^\r\n]*)$", 1))
    return first_literal(F.concat(said, F.filter(F.array(last), lambda x: x != "")))


def condition_text(state: Column, rest: Column) -> Column:
    """State and rest of a program as a prompt."""
    return F.concat(F.lit("STATE: "), state, F.lit("\nTAIL:\n"), rest)
