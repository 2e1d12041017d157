"""Typed values: a Spark column with what is known statically about it.

The query language is dynamically typed and Spark is not.  Every expression therefore carries
a static type, found from the graph's schema, and what the language defines for values of
different types is decided here, before Spark sees the operation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("int", "float")
#: Temporal kinds and the Spark types that carry them; times and zoned datetimes are structs.
TEMPORAL = ("date", "localtime", "time", "localdatetime", "datetime")


@dataclass(frozen=True)
class Type:
    """``name``: null, bool, int, float, string, list, map, node, rel, bytes, variant or a temporal kind."""

    name: str
    item: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()

    @property
    def number(self) -> bool:
        return self.name in NUMBERS

    def field(self, key: str) -> Type | None:
        return dict(self.fields).get(key)


NULL, BOOL, INT, FLOAT, STRING, BYTES = map(Type, ("null", "bool", "int", "float", "string", "bytes"))
DURATION = Type("duration")


def list_of(item: Type) -> Type:
    return Type("list", item)


@dataclass(frozen=True)
class Value:
    """``const`` holds the Python value of a constant; ``alias`` the variable an entity is bound to."""

    type: Type
    col: Column
    const: object = None
    is_const: bool = False
    alias: str | None = None


def null(kind: Type = NULL) -> Value:
    return Value(kind, F.lit(None).cast(spark_type(kind)) if kind.name != "null" else F.lit(None), None, True)


def spark_type(t: Type) -> T.DataType:
    simple = {"null": T.NullType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "date": T.DateType(), "localdatetime": T.TimestampNTZType()}
    if t.name in simple:
        return simple[t.name]
    if t.name == "list":
        return T.ArrayType(spark_type(t.item or NULL))
    if t.name == "map":
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in t.fields])
    if t.name == "duration":
        return T.StructType([T.StructField("months", T.LongType()), T.StructField("days", T.LongType()), T.StructField("micros", T.LongType())])
    if t.name in ("time", "localtime", "datetime"):
        return T.StructType([T.StructField("local", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("zone", T.StringType())])
    raise TypeError(t)


def from_spark(t: T.DataType) -> Type:
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.DateType):
        return Type("date")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Type("localdatetime")
    if isinstance(t, T.ArrayType):
        return list_of(from_spark(t.elementType))
    if isinstance(t, T.StructType):
        return Type("map", fields=tuple((f.name, from_spark(f.dataType)) for f in t.fields))
    if isinstance(t, T.NullType):
        return NULL
    return STRING


def column_value(col: Column, t: T.DataType) -> Value:
    """A stored column as a value: whole numbers are 64-bit, decimals doubles, timestamps local."""
    kind = from_spark(t)
    return Value(kind, col.cast(spark_type(kind)) if kind.name not in ("map",) else col)


def literal(x: object) -> Value:
    """A Python value, as of a literal or a parameter."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(BOOL, F.lit(x), x, True)
    if isinstance(x, int):
        return Value(INT, F.lit(x).cast("bigint"), x, True)
    if isinstance(x, float):
        return Value(FLOAT, F.lit(x).cast("double"), x, True)
    if isinstance(x, str):
        return Value(STRING, F.lit(x), x, True)
    if isinstance(x, (bytes, bytearray)):
        return Value(BYTES, F.lit(bytes(x)), bytes(x), True)
    if isinstance(x, (list, tuple)):
        out = make_list([literal(v) for v in x])
        return Value(out.type, out.col, list(x), True)
    if isinstance(x, dict):
        out = make_map([(k, literal(v)) for k, v in x.items()])
        return Value(out.type, out.col, dict(x), True)
    raise TypeError(f"no value of the language: {x!r}")


def common(types: list[Type]) -> Type | None:
    """The type all can be widened to, or None where they differ in kind."""
    out = NULL
    for t in types:
        if t.name == "null" or t == out:
            continue
        if out.name == "null":
            out = t
        elif t.number and out.number:
            out = FLOAT
        elif t.name == out.name == "list":
            item = common([t.item or NULL, out.item or NULL])
            if item is None:
                return None
            out = list_of(item)
        elif t.name == out.name == "map":
            keys = dict.fromkeys([k for k, _ in out.fields] + [k for k, _ in t.fields])
            merged = {k: common([out.field(k) or NULL, t.field(k) or NULL]) for k in keys}
            if None in merged.values():
                return None
            out = Type("map", fields=tuple(merged.items()))
        else:
            return None
    return out


def widened(v: Value, t: Type) -> Column:
    if v.type == t or t.name == "null":
        return v.col
    if v.type.name == "null":
        return F.lit(None).cast(spark_type(t))
    if t.name == "string" and v.type.name != "string":
        return as_text(v).col
    if t.name == "map":
        parts = [F.when(v.col.isNotNull(), widened(Value(v.type.field(k), v.col.getField(k)), ft)).alias(k) if v.type.field(k) else F.lit(None).cast(spark_type(ft)).alias(k) for k, ft in t.fields]
        return F.when(v.col.isNotNull(), F.struct(*parts))
    if t.name == "list" and v.type.item and v.type.item.name == "map":
        return F.transform(v.col, lambda x: widened(Value(v.type.item, x), t.item))
    return v.col.cast(spark_type(t))


def make_list(items: list[Value]) -> Value:
    kind = common([v.type for v in items])
    if kind is None:  # items of several kinds: their texts
        kind = STRING
    if not items:
        return Value(list_of(NULL), F.array(), [], True)
    out = F.array(*[widened(v, kind) for v in items])
    const = all(v.is_const for v in items)
    return Value(list_of(kind), out, [v.const for v in items] if const else None, const)


def make_map(items: list[tuple[str, Value]]) -> Value:
    items = sorted(dict(items).items())
    kind = Type("map", fields=tuple((k, v.type) for k, v in items))
    out = F.struct(*[v.col.alias(k) for k, v in items]) if items else F.struct(F.lit(None).alias("_"))
    const = all(v.is_const for _, v in items)
    return Value(kind, out, {k: v.const for k, v in items} if const else None, const)


# -- comparison and logic


def _nan_free(a: Value, b: Value, test: Column) -> Column:
    for v in (a, b):
        if v.type.name == "float":
            test = F.when(F.isnan(v.col), F.lit(False)).otherwise(test)
    return test


def both_known(a: Column, b: Column, result: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), result)


def equal(a: Value, b: Value) -> Value:
    """Null if either is null; numbers by value; values of different kinds are not equal."""
    if "null" in (a.type.name, b.type.name):
        return null(BOOL)
    if a.type.number and b.type.number:
        test = a.col == b.col
        test = _nan_free(a, b, test) if "float" in (a.type.name, b.type.name) else test
        return Value(BOOL, both_known(a.col, b.col, test) if "float" in (a.type.name, b.type.name) else test)
    if a.type.name != b.type.name:
        return Value(BOOL, both_known(a.col, b.col, F.lit(False)))
    if a.type.name == "list":
        x, y = a.type.item or NULL, b.type.item or NULL
        if "null" in (x.name, y.name):
            some = (F.size(a.col) == F.size(b.col)) & (F.size(a.col) > 0)
            return Value(BOOL, both_known(a.col, b.col, F.when(some, F.lit(None).cast("boolean")).otherwise(F.size(a.col) == F.size(b.col))))
        tests = F.zip_with(a.col, b.col, lambda p, q: equal(Value(x, p), Value(y, q)).col)
        return Value(BOOL, both_known(a.col, b.col, F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(F.forall(tests, lambda t: t))))
    if a.type.name == "map":
        if {k for k, _ in a.type.fields} != {k for k, _ in b.type.fields}:
            return Value(BOOL, both_known(a.col, b.col, F.lit(False)))
        out = F.lit(True)
        for k, t in a.type.fields:
            out = out & equal(Value(t, a.col.getField(k)), Value(b.type.field(k), b.col.getField(k))).col
        return Value(BOOL, both_known(a.col, b.col, out))
    if a.type.name in ("time", "datetime", "localtime"):
        return Value(BOOL, _instant(a.col) == _instant(b.col))
    return Value(BOOL, a.col == b.col)


def _instant(c: Column) -> Column:
    return c["local"] - F.coalesce(c["offset"], F.lit(0)).cast("bigint") * 1_000_000


def compare(op: str, a: Value, b: Value) -> Value:
    """Null unless the two are numbers, booleans, strings, lists or of one temporal kind."""
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    if "null" in (a.type.name, b.type.name):
        return null(BOOL)
    if a.type.number and b.type.number:
        test = ops[op](a.col, b.col)
        return Value(BOOL, both_known(a.col, b.col, _nan_free(a, b, test)) if "float" in (a.type.name, b.type.name) else test)
    if a.type.name != b.type.name:
        return null(BOOL)
    if a.type.name in ("bool", "string", "date", "localdatetime"):
        return Value(BOOL, ops[op](a.col, b.col))
    if a.type.name in ("time", "datetime", "localtime"):
        return Value(BOOL, ops[op](_instant(a.col), _instant(b.col)))
    if a.type.name == "list":
        x, y = a.type.item or NULL, b.type.item or NULL
        if common([x, y]) is None or "null" in (x.name, y.name):
            return null(BOOL)
        # the first place where the two differ or can't be told apart decides
        pairs = F.filter(F.zip_with(a.col, b.col, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: ~F.coalesce(equal(Value(x, z["p"]), Value(y, z["q"])).col, F.lit(False)))
        at = F.size(F.filter(F.zip_with(F.slice(a.col, 1, F.least(F.size(a.col), F.size(b.col))), F.slice(b.col, 1, F.least(F.size(a.col), F.size(b.col))), lambda p, q: ~F.coalesce(equal(Value(x, p), Value(y, q)).col, F.lit(False))), lambda z: z))
        first = F.get(pairs, F.lit(0))
        inner = compare(op[0], Value(x, first["p"]), Value(y, first["q"])).col
        return Value(BOOL, both_known(a.col, b.col, F.when(at > 0, inner).otherwise(ops[op](F.size(a.col), F.size(b.col)))))
    return null(BOOL)


def truth(v: Value) -> Column:
    return v.col if v.type.name == "bool" else F.lit(None).cast("boolean")


def contains(item: Value, source: Value) -> Value:
    """``IN``: false for an empty list whatever the item, else three-valued."""
    if source.type.name == "null":
        return null(BOOL)
    if source.type.name != "list":
        return null(BOOL)
    kind = source.type.item or NULL
    if kind.name == "null":
        found = F.lit(None).cast("boolean")
    elif item.type.name == "null":
        found = F.lit(None).cast("boolean")
    elif source.is_const and common([item.type, kind]) in (kind, item.type) and kind.name in ("int", "float", "string", "bool") and None not in source.const and source.const:
        return Value(BOOL, item.col.isin(*source.const))
    else:
        found = F.exists(source.col, lambda x: equal(item, Value(kind, x)).col)
    return Value(BOOL, F.when(source.col.isNull(), F.lit(None).cast("boolean")).when(F.size(source.col) == 0, F.lit(False)).otherwise(found))


def text_test(op: str, a: Value, b: Value) -> Value:
    if a.type.name != "string" or b.type.name != "string":
        return null(BOOL)
    return Value(BOOL, {"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col))


# -- arithmetic


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Numbers only; whole numbers divide towards zero and null on zero, floats follow IEEE."""
    if not (a.type.number and b.type.number):
        return null()
    if op == "^":
        return Value(FLOAT, F.pow(a.col.cast("double"), b.col.cast("double")))
    if a.type.name == b.type.name == "int":
        if op in "+-*":
            return Value(INT, {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a.col, b.col))
        if op == "/":
            return Value(INT, F.when(b.col != 0, F.when(b.col == -1, F.try_subtract(F.lit(0).cast("bigint"), a.col)).otherwise(_div(a.col, b.col))))
        return Value(INT, F.try_mod(a.col, b.col))
    x, y = a.col.cast("double"), b.col.cast("double")
    if op == "/":
        signed = F.when((x == 0) | F.isnan(x), F.lit(math.nan)).otherwise(F.signum(x) * F.lit(math.inf))
        return Value(FLOAT, F.when(y == 0, signed).otherwise(x / F.when(y != 0, y)))
    if op == "%":
        return Value(FLOAT, F.when(y != 0, F.try_mod(x, y)))
    return Value(FLOAT, {"+": x + y, "-": x - y, "*": x * y}[op])


def _div(a: Column, b: Column) -> Column:
    """Division of whole numbers towards zero without passing through floats."""
    return F.call_function("div", a, F.when((b != 0) & (b != -1), b))


def plus(a: Value, b: Value) -> Value:
    if a.type.number and b.type.number:
        return arithmetic("+", a, b)
    if a.type.name == b.type.name == "string":
        return Value(STRING, F.concat(a.col, b.col))
    if a.type.name == "list" and b.type.name == "list":
        kind = common([a.type, b.type]) or list_of(STRING)
        return Value(kind, F.concat(widened(a, kind), widened(b, kind)))
    if a.type.name == "list" or b.type.name == "list":
        source, item = (a, b) if a.type.name == "list" else (b, a)
        kind = common([source.type.item or NULL, item.type])
        if kind is None or kind.name == "null":
            return null()
        one = F.array(widened(item, kind))
        return Value(list_of(kind), F.concat(widened(source, list_of(kind)), one) if source is a else F.concat(one, widened(source, list_of(kind))))
    return null()


# -- text


def as_text(v: Value) -> Value:
    """``toString``: a whole float has no decimal point."""
    if v.type.name == "string":
        return v
    if v.type.name == "bool":
        return Value(STRING, v.col.cast("string"))
    if v.type.name == "int":
        return Value(STRING, v.col.cast("string"))
    if v.type.name == "float":
        x = v.col
        whole = (x == F.floor(x)) & (F.abs(x) < 9e15)
        text = F.when(F.isnan(x), F.lit("NaN")).when(x == math.inf, F.lit("inf")).when(x == -math.inf, F.lit("-inf")).when(whole, F.when(F.abs(x) < 9e15, x).cast("bigint").cast("string")).otherwise(x.cast("string"))
        return Value(STRING, F.when(x.isNotNull(), text))
    if v.type.name in TEMPORAL or v.type.name == "duration":
        from ..functions.temporal import to_text

        return Value(STRING, to_text(v))
    return null(STRING)
