"""Names of result columns without an alias: the expression's text."""

from __future__ import annotations

from . import ast as A
from .parser import POWERS

LONGEST = 120


def _power(e: A.Expr) -> int:
    if isinstance(e, A.Binary):
        return POWERS.get(e.op.split()[0], 40)
    if isinstance(e, A.Unary):
        return 40 if e.op == "NOT" else 80
    return 100


def _side(e: A.Expr, power: int, right: bool = False) -> str:
    own = _power(e)
    return f"({text_of(e)})" if own < power or right and own == power else text_of(e)


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else repr(x)


def text_of(e: A.Expr) -> str:
    if isinstance(e, A.Literal):
        v = e.value
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return f"'{v}'" if isinstance(v, str) else _number(v) if isinstance(v, float) else str(v)
    if isinstance(e, A.Param):
        return f"${e.name}"
    if isinstance(e, A.Var):
        return e.name
    if isinstance(e, A.Prop):
        return f"{e.base.name}.{e.key}" if isinstance(e.base, A.Var) else f"({text_of(e.base)}).{e.key}"
    if isinstance(e, A.Unary):
        return f"NOT {_side(e.arg, 40)}" if e.op == "NOT" else f"-{_side(e.arg, 80)}"
    if isinstance(e, A.Binary):
        power = _power(e)
        return f"{_side(e.left, power)} {e.op} {_side(e.right, power, True)}"
    if isinstance(e, A.IsNull):
        return f"{_side(e.arg, 100)} IS {'NOT ' * e.negated}NULL"
    if isinstance(e, A.HasLabels):
        return text_of(e.arg) + "".join(f":{x}" for x in e.labels)
    if isinstance(e, A.ListOf):
        return f"[{', '.join(map(text_of, e.items))}]"
    if isinstance(e, A.MapOf):
        return "{" + ", ".join(f"{k}: {text_of(v)}" for k, v in e.items) + "}"
    if isinstance(e, A.Index):
        return f"{text_of(e.base)}[{text_of(e.at)}]"
    if isinstance(e, A.Call):
        return f"{e.name}({'*' if e.star else 'DISTINCT ' * e.distinct + ', '.join(map(text_of, e.args))})"
    if isinstance(e, A.Case):
        return "case(...)"
    return ""


def column_name(e: A.Expr, index: int) -> str:
    text = text_of(e)
    return text if text and len(text.encode()) <= LONGEST else f"expr_{index}"
