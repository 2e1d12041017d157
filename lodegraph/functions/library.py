"""The scalar functions, by lower-case name.  Each takes the compiler and typed arguments.

Arguments of a wrong type give null, but for conversions and graph functions, which refuse them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuerySyntaxError
from ..operators import values as V
from ..operators.values import BOOL, FLOAT, INT, STRING, Type, Value, list_of, null

LIBRARY: dict[str, Callable] = {}
#: Characters of Unicode white space, for trimming.
BLANK = "[\\s\\x{85}\\p{Z}]"
RANGE_LIMIT = 1_100_000


def function(name: str, least: int, most: int | None = None):
    def register(f: Callable) -> Callable:
        def checked(ctx, args: list[Value]) -> Value:
            if not least <= len(args) <= (least if most is None else most):
                raise QuerySyntaxError(f"InvalidNumberOfArguments ({name})")
            return f(ctx, *args)

        LIBRARY[name.lower()] = checked
        return f

    return register


def refused(name: str) -> QuerySyntaxError:
    return QuerySyntaxError(f"InvalidArgumentType ({name})")


# -- text


def _on_text(name: str, body: Callable[[Column], Column], out: Type = STRING) -> None:
    function(name, 1)(lambda ctx, s: Value(out, body(s.col)) if s.type == STRING else null(out))


_on_text("toLower", F.lower)
_on_text("toUpper", F.upper)
_on_text("trim", lambda s: F.regexp_replace(s, f"^{BLANK}+|{BLANK}+$", ""))
_on_text("ltrim", lambda s: F.regexp_replace(s, f"^{BLANK}+", ""))
_on_text("rtrim", lambda s: F.regexp_replace(s, f"{BLANK}+$", ""))


@function("substring", 2, 3)
def substring(ctx, s: Value, start: Value, length: Value | None = None) -> Value:
    if s.type != STRING or start.type != INT or length is not None and length.type != INT:
        return null(STRING)
    n = F.char_length(s.col).cast("bigint") if length is None else length.col
    body = F.substring(s.col, (start.col + 1).cast("int"), F.greatest(F.least(n, F.lit(2**31 - 1)), F.lit(0)).cast("int"))
    return Value(STRING, F.when((start.col < 0) | (start.col >= F.char_length(s.col)), F.when(s.col.isNotNull() & n.isNotNull(), F.lit(""))).otherwise(body))


def _end(name: str, body: Callable) -> None:
    def run(ctx, s: Value, n: Value) -> Value:
        if s.type != STRING or n.type != INT:
            return null(STRING)
        return Value(STRING, V.both_known(s.col, n.col, F.when(n.col <= 0, F.lit("")).otherwise(body(s.col, F.least(n.col, F.lit(2**31 - 1)).cast("int")))))

    function(name, 2)(run)


_end("left", F.left)
_end("right", F.right)


@function("replace", 3)
def replace(ctx, s: Value, old: Value, new: Value) -> Value:
    if not s.type == old.type == new.type == STRING:
        return null(STRING)
    between = F.concat(new.col, F.call_function("array_join", F.split(s.col, ""), new.col), F.when(F.char_length(s.col) > 0, new.col).otherwise(F.lit("")))
    return Value(STRING, F.when(old.col == "", between).otherwise(F.replace(s.col, old.col, new.col)))


@function("split", 2)
def split(ctx, s: Value, mark: Value) -> Value:
    if s.type != STRING or mark.type != STRING:
        return null(list_of(STRING))
    quoted = F.concat(F.lit("\\Q"), F.replace(mark.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letters = F.concat(F.array(F.lit("")), F.filter(F.split(s.col, ""), lambda x: x != ""), F.array(F.lit("")))
    return Value(list_of(STRING), F.when(mark.col == "", letters).otherwise(F.split(s.col, quoted, -1)))


@function("reverse", 1)
def reverse(ctx, x: Value) -> Value:
    return Value(x.type, F.reverse(x.col)) if x.type.name in ("string", "list") else null()


# -- conversion


@function("toString", 1)
def to_string(ctx, x: Value) -> Value:
    if x.type.name in ("node", "rel", "list", "map"):
        raise refused("toString")
    return V.as_text(x) if x.type.name != "null" else null(STRING)


_NUMERAL = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


@function("toInteger", 1)
def to_integer(ctx, x: Value) -> Value:
    if x.type.name in ("node", "rel", "list", "map", "bool"):
        raise refused("toInteger")
    if x.type == INT:
        return x
    if x.type == STRING:
        whole = F.when(x.col.rlike("^[+-]?[0-9]+$"), x.col.try_cast("bigint"))
        part = F.when(x.col.rlike(_NUMERAL), x.col.try_cast("double"))
        return Value(INT, F.coalesce(whole, _truncated(part)))
    return Value(INT, _truncated(x.col)) if x.type == FLOAT else null(INT)


def _truncated(x: Column) -> Column:
    fits = ~F.isnan(x) & (x >= -(2.0**63)) & (x < 2.0**63)
    return F.when(fits, F.when(fits, x).cast("bigint"))


@function("toFloat", 1)
def to_float(ctx, x: Value) -> Value:
    if x.type.name in ("node", "rel", "list", "map", "bool"):
        raise refused("toFloat")
    if x.type.number:
        return Value(FLOAT, x.col.cast("double"))
    if x.type != STRING:
        return null(FLOAT)
    value = F.when(x.col.rlike(_NUMERAL), x.col.try_cast("double"))
    return Value(FLOAT, F.when(F.abs(value) != math.inf, value))


@function("toBoolean", 1)
def to_boolean(ctx, x: Value) -> Value:
    if x.type == BOOL:
        return x
    if x.type.name not in ("string", "null"):
        raise refused("toBoolean")
    low = F.lower(x.col)
    return Value(BOOL, F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))) if x.type == STRING else null(BOOL)


# -- numbers


def _on_number(name: str, body: Callable[[Column], Column]) -> None:
    function(name, 1)(lambda ctx, x: Value(FLOAT, body(x.col.cast("double"))) if x.type.number else null(FLOAT))


_on_number("ceil", lambda x: F.when(F.abs(x) < 9e15, F.ceil(x).cast("double")).otherwise(x))
_on_number("floor", lambda x: F.when(F.abs(x) < 9e15, F.floor(x).cast("double")).otherwise(x))
_on_number("round", lambda x: F.when(F.abs(x) < 4e15, F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")).otherwise(x))
_on_number("sqrt", F.sqrt)


@function("abs", 1)
def absolute(ctx, x: Value) -> Value:
    if x.type == INT:
        return Value(INT, F.when(x.col < 0, F.try_subtract(F.lit(0).cast("bigint"), x.col)).otherwise(x.col))
    return Value(FLOAT, F.abs(x.col)) if x.type == FLOAT else null()


@function("sign", 1)
def sign(ctx, x: Value) -> Value:
    return Value(INT, F.when(x.col > 0, F.lit(1)).when(x.col < 0, F.lit(-1)).when(x.col.isNotNull(), F.lit(0)).cast("bigint")) if x.type.number else null(INT)


@function("log", 1, 2)
def logarithm(ctx, x: Value, y: Value | None = None) -> Value:
    if not x.type.number or y is not None and not y.type.number:
        return null(FLOAT)
    if y is None:
        return Value(FLOAT, F.when(x.col > 0, F.ln(x.col.cast("double"))))
    base, of = x.col.cast("double"), y.col.cast("double")
    return Value(FLOAT, F.when((base > 0) & (base != 1) & (of > 0), F.ln(of) / F.ln(base)))


function("e", 0)(lambda ctx: Value(FLOAT, F.lit(math.e), math.e, True))
function("pi", 0)(lambda ctx: Value(FLOAT, F.lit(math.pi), math.pi, True))
function("rand", 0)(lambda ctx: Value(FLOAT, F.lit(0.42), 0.42, True))  # the language fixes it


# -- lists and maps


@function("size", 1)
def size(ctx, x: Value) -> Value:
    if x.type == STRING:
        return Value(INT, F.char_length(x.col).cast("bigint"))
    if x.type.name == "list":
        return Value(INT, F.when(x.col.isNotNull(), F.size(x.col)).cast("bigint"))
    if x.type.name == "map":
        return Value(INT, F.when(x.col.isNotNull(), F.lit(len(x.type.fields))).cast("bigint"))
    if x.type.name in ("node", "rel"):
        raise refused("size")
    return null(INT)


def _of_list(name: str, body: Callable[[Column], Column], same: bool = False) -> None:
    def run(ctx, x: Value) -> Value:
        if x.type.name != "list":
            return null()
        return Value(x.type if same else x.type.item or V.NULL, body(x.col))

    function(name, 1)(run)


_of_list("head", lambda x: F.get(x, F.lit(0)))
_of_list("last", lambda x: F.try_element_at(x, F.lit(-1)))
_of_list("tail", lambda x: F.when(F.size(x) == 0, x).otherwise(F.slice(x, 2, F.greatest(F.size(x), F.lit(1)))), same=True)


@function("range", 2, 3)
def int_range(ctx, low: Value, high: Value, step: Value | None = None) -> Value:
    step = step or V.literal(1)
    if not low.type == high.type == step.type == INT:
        return null(list_of(INT))
    if low.is_const and high.is_const and step.is_const and step.const and abs(high.const - low.const) // abs(step.const) >= RANGE_LIMIT:
        raise QuerySyntaxError("NumberOutOfRange (range)")
    empty = F.when(step.col > 0, low.col > high.col).otherwise(low.col < high.col)
    safe = F.sequence(low.col, F.when(empty, low.col).otherwise(high.col), F.when(empty, F.lit(1).cast("bigint")).otherwise(step.col))
    known = low.col.isNotNull() & high.col.isNotNull() & (step.col != 0)
    return Value(list_of(INT), F.when(known, F.when(empty, F.array().cast("array<bigint>")).otherwise(safe)))


@function("coalesce", 1, 100)
def coalesce(ctx, *args: Value) -> Value:
    kind = V.common([a.type for a in args]) or STRING
    return Value(kind, F.coalesce(*[V.widened(a, kind) for a in args]))


@function("keys", 1)
def keys(ctx, x: Value) -> Value:
    if x.type.name == "map":
        return Value(list_of(STRING), F.when(x.col.isNotNull(), F.array(*[F.lit(k) for k, _ in x.type.fields]).cast("array<string>")))
    if x.type.name in ("node", "rel"):
        props = sorted(ctx.properties(x).items())
        names = F.array(*[F.when(v.col.isNotNull(), F.lit(k)) for k, v in props]).cast("array<string>")
        return Value(list_of(STRING), F.when(ctx.present(x), F.filter(names, lambda k: k.isNotNull())))
    return null(list_of(STRING))


@function("properties", 1)
def properties(ctx, x: Value) -> Value:
    if x.type.name == "map":
        return x
    if x.type.name in ("node", "rel"):
        out = V.make_map(list(ctx.properties(x).items()))
        some = F.coalesce(*[v.col.cast("string") for v in ctx.properties(x).values()], F.lit(None)).isNotNull()
        return Value(out.type, F.when(some, out.col))
    if x.type.name == "null":
        return null()
    raise refused("properties")


for _name in ("length", "nodes", "relationships"):

    def _path_only(ctx, x: Value, _name: str = _name) -> Value:
        if x.type.name == "null":
            return null()
        raise refused(_name)

    function(_name, 1)(_path_only)


# -- graph


@function("id", 1)
def identity(ctx, x: Value) -> Value:
    """A node's id; a relationship's is that of its source, as the language has it."""
    if x.type.name in ("node", "rel"):
        return Value(INT, ctx.part(x, "id" if x.type.name == "node" else "src"))
    return null(INT)


@function("labels", 1)
def labels(ctx, x: Value) -> Value:
    if x.type.name == "node":
        return Value(list_of(STRING), ctx.part(x, "labels"))
    if x.type.name == "null":
        return null(list_of(STRING))
    raise refused("labels")


@function("type", 1)
def rel_type(ctx, x: Value) -> Value:
    if x.type.name == "rel":
        return Value(STRING, ctx.part(x, "type"))
    if x.type.name == "null":
        return null(STRING)
    raise refused("type")


@function("startNode", 1)
def start_node(ctx, x: Value) -> Value:
    if x.type.name != "rel":
        return null()
    return ctx.endpoint(x, "src")


@function("endNode", 1)
def end_node(ctx, x: Value) -> Value:
    if x.type.name != "rel":
        return null()
    return ctx.endpoint(x, "dst")
