"""Expressions compiled to typed columns over a scope of variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cypher import ast as A
from ..errors import QuerySyntaxError, outside
from ..functions import temporal
from ..functions.library import LIBRARY
from . import values as V
from .values import BOOL, STRING, Type, Value, list_of, null

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect", "percentiledisc", "percentilecont", "stdev", "stdevp")


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Entity:
    """A node or relationship variable: its properties are columns named after it."""

    kind: str  # node or rel
    name: str
    props: dict[str, Type]
    types: tuple[str, ...] = ()
    labels: tuple[str, ...] | None = None  # where all rows have these
    scanned: bool = True
    ends: tuple[str, str] | None = None  # variables of a relationship's source and target

    def column(self, part: str) -> str:
        return f"{self.name}|{part}"

    def prop_column(self, key: str) -> str:
        return f"{self.name}.{key}"


@dataclass
class Scope:
    entities: dict[str, Entity] = field(default_factory=dict)
    values: dict[str, Value] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [n for n in (*self.entities, *self.values) if not n.startswith("_gen")]

    def copy(self) -> Scope:
        return Scope(dict(self.entities), dict(self.values))


class Compiler:
    def __init__(self, scope: Scope, params: dict, extended: bool = False, locals_: dict[str, Value] | None = None, exists=None):
        self.scope, self.params, self.extended, self.locals, self.exists = scope, params, extended, locals_ or {}, exists

    # -- what functions ask about entities

    def entity(self, v: Value) -> Entity:
        return self.scope.entities[v.alias]

    def part(self, v: Value, part: str) -> Column:
        return ref(self.entity(v).column(part))

    def present(self, v: Value) -> Column:
        return self.part(v, "id" if v.type.name == "node" else "src").isNotNull()

    def properties(self, v: Value) -> dict[str, Value]:
        e = self.entity(v)
        return {k: Value(t, ref(e.prop_column(k))) for k, t in e.props.items()}

    def endpoint(self, v: Value, end: str) -> Value:
        """The variable of an end, where the pattern binds it; in the order of writing."""
        e = self.entity(v)
        if e.ends is None:
            return null()
        name = e.ends[0 if end == "src" else 1]
        return self.variable(name)

    def struct(self, v: Value) -> Column:
        """An entity as one column."""
        e = self.entity(v)
        props = [ref(e.prop_column(k)).alias(k) for k in sorted(e.props)]
        inner = F.struct(*props).alias("properties") if props else F.struct(F.lit(None).cast("string").alias("_")).alias("properties")
        if e.kind == "node":
            return F.when(self.present(v), F.struct(ref(e.column("id")).alias("id"), ref(e.column("labels")).alias("labels"), inner))
        return F.when(self.present(v), F.struct(*[ref(e.column(p)).alias(p) for p in ("src", "type", "dst")], inner))

    # -- compilation

    def __call__(self, e: A.Expr) -> Value:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def inner(self, **names: Value) -> Compiler:
        return Compiler(self.scope, self.params, self.extended, self.locals | names, self.exists)

    def variable(self, name: str) -> Value:
        if name in self.locals:
            return self.locals[name]
        if name in self.scope.values:
            return self.scope.values[name]
        if name in self.scope.entities:
            e = self.scope.entities[name]
            return Value(Type(e.kind), ref(e.column("id" if e.kind == "node" else "src")), alias=name)
        raise QuerySyntaxError(f"UndefinedVariable ({name})")

    def _literal(self, e: A.Literal) -> Value:
        return V.literal(e.value)

    def _param(self, e: A.Param) -> Value:
        return V.literal(self.params.get(e.name))

    def _var(self, e: A.Var) -> Value:
        return self.variable(e.name)

    def _prop(self, e: A.Prop) -> Value:
        base = self(e.base)
        if base.type.name in ("node", "rel"):
            entity = self.entity(base)
            kind = entity.props.get(e.key)
            return null() if kind is None else Value(kind, ref(entity.prop_column(e.key)))
        if base.type.name == "map":
            kind = base.type.field(e.key)
            return null() if kind is None else Value(kind, base.col.getField(e.key))
        if base.type.name in V.TEMPORAL or base.type.name == "duration" or base.type.name == "string":
            return temporal.accessor(base, e.key)
        if base.type.name == "null":
            return null()
        raise QuerySyntaxError("InvalidArgumentType")

    def _unary(self, e: A.Unary) -> Value:
        if e.op == "NOT":
            self._boolean_operand(e.arg)
            v = self(e.arg)
            return Value(BOOL, ~V.truth(v))
        v = self(e.arg)
        if v.type.name == "duration":
            return temporal.scaled(v, V.literal(-1))
        if not v.type.number:
            return null()
        if v.is_const and v.const is not None:
            return V.literal(-v.const)
        return Value(v.type, F.try_subtract(F.lit(0).cast("bigint"), v.col) if v.type.name == "int" else -v.col)

    def _boolean_operand(self, e: A.Expr) -> None:
        """Operands that can't be true or false are refused at once."""
        literal = isinstance(e, A.Literal) and e.value is not None and not isinstance(e.value, bool)
        arithmetic = isinstance(e, A.Binary) and e.op in ("+", "-", "*", "/", "%", "^") or isinstance(e, A.Unary) and e.op == "-"
        if literal or arithmetic or isinstance(e, (A.ListOf, A.MapOf)):
            raise QuerySyntaxError("InvalidArgumentType")

    def _binary(self, e: A.Binary) -> Value:
        op = e.op
        if op in ("AND", "OR", "XOR"):
            self._boolean_operand(e.left)
            self._boolean_operand(e.right)
            a, b = V.truth(self(e.left)), V.truth(self(e.right))
            return Value(BOOL, a & b if op == "AND" else a | b if op == "OR" else a != b)
        if op == "IN" and (isinstance(e.right, A.MapOf) or isinstance(e.right, A.Literal) and e.right.value is not None):
            raise QuerySyntaxError("InvalidArgumentType")
        a, b = self(e.left), self(e.right)
        if op in ("=", "<>"):
            same = self._equal(a, b)
            return same if op == "=" else Value(BOOL, ~same.col)
        if op in ("<", "<=", ">", ">="):
            return V.compare(op, *temporal.aligned(a, b))
        if op == "IN":
            return V.contains(a, b)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return V.text_test(op, a, b)
        names = {a.type.name, b.type.name}
        if "duration" in names:
            return temporal.arithmetic(op, a, b)
        folded = self._folded(op, a, b)
        if folded is not None:
            return folded
        return V.plus(a, b) if op == "+" else V.arithmetic(op, a, b)

    def _folded(self, op: str, a: Value, b: Value) -> Value | None:
        """Whole-number constants: a sum or product beyond 64 bits is a float."""
        if op in ("+", "-", "*") and a.is_const and b.is_const and type(a.const) is int and type(b.const) is int:
            out = {"+": a.const + b.const, "-": a.const - b.const, "*": a.const * b.const}[op]
            return V.literal(out if -(1 << 63) <= out < 1 << 63 else float(out))
        return None

    def _equal(self, a: Value, b: Value) -> Value:
        if a.type.name == b.type.name == "node":
            return Value(BOOL, self.part(a, "id") == self.part(b, "id"))
        if a.type.name == b.type.name == "rel":
            same = [self.part(a, p) == self.part(b, p) for p in ("src", "type", "dst")]
            return Value(BOOL, same[0] & same[1] & same[2])
        return V.equal(*temporal.aligned(a, b))

    def _isnull(self, e: A.IsNull) -> Value:
        v = self(e.arg)
        test = v.col.isNull() if v.type.name != "null" else F.lit(True)
        return Value(BOOL, ~test if e.negated else test)

    def _haslabels(self, e: A.HasLabels) -> Value:
        v = self(e.arg)
        if v.type.name == "node":
            test = F.lit(True)
            for label in e.labels:
                test = test & F.array_contains(self.part(v, "labels"), label)
        elif v.type.name == "rel":
            test = self.part(v, "type") == e.labels[0] if len(set(e.labels)) == 1 else F.lit(False)
        elif v.type.name == "null":
            return null(BOOL)
        else:
            raise QuerySyntaxError("InvalidArgumentType")
        return Value(BOOL, F.when(self.present(v), test))

    def _listof(self, e: A.ListOf) -> Value:
        return V.make_list([self(x) for x in e.items])

    def _mapof(self, e: A.MapOf) -> Value:
        return V.make_map([(k, self(x)) for k, x in e.items])

    def _index(self, e: A.Index) -> Value:
        base, at = self(e.base), self(e.at)
        if base.type.name == "list":
            if at.type.name not in ("int", "null"):
                raise QuerySyntaxError("InvalidArgumentType")
            item = base.type.item or V.NULL
            if at.type.name == "null":
                return null(item)
            place = F.when(at.col < 0, at.col + F.size(base.col)).otherwise(at.col).cast("int")
            return Value(item, F.get(base.col, place))
        if base.type.name in ("map", "node", "rel"):
            if at.is_const and isinstance(at.const, str):
                return self._prop_of(base, at.const)
            if at.type.name != "string":
                raise QuerySyntaxError("InvalidArgumentType")
            found = self.properties(base) if base.type.name != "map" else {k: Value(t, base.col.getField(k)) for k, t in base.type.fields}
            kind = V.common([v.type for v in found.values()]) or STRING
            out = F.lit(None)
            for k, v in found.items():
                out = F.when(at.col == k, V.widened(v, kind)).otherwise(out)
            return Value(kind, out)
        if base.type.name == "null":
            return null()
        raise QuerySyntaxError("InvalidArgumentType")

    def _prop_of(self, base: Value, key: str) -> Value:
        if base.type.name == "map":
            kind = base.type.field(key)
            return null() if kind is None else Value(kind, base.col.getField(key))
        return self.properties(base).get(key) or null()

    def _slice(self, e: A.Slice) -> Value:
        base = self(e.base)
        low = self(e.low) if e.low else V.literal(0)
        high = self(e.high) if e.high else None
        bounds = [x for x in (low, high) if x is not None]
        if base.type.name not in ("list", "string") or any(x.type.name == "null" for x in bounds):
            return null(base.type if base.type.name in ("list", "string") else V.NULL)
        if any(x.type.name != "int" for x in bounds):
            raise QuerySyntaxError("InvalidArgumentType")
        n = (F.size(base.col) if base.type.name == "list" else F.char_length(base.col)).cast("bigint")
        place = lambda x: F.greatest(F.lit(0), F.least(n, F.when(x < 0, x + n).otherwise(x)))
        a = place(low.col)
        b = n if high is None else place(high.col)
        known = base.col.isNotNull() & low.col.isNotNull() & (F.lit(True) if high is None else high.col.isNotNull())
        count = F.greatest(F.lit(0), b - a).cast("int")
        cut = F.slice(base.col, (a + 1).cast("int"), count) if base.type.name == "list" else F.substring(base.col, (a + 1).cast("int"), count)
        return Value(base.type, F.when(known, cut))

    def _case(self, e: A.Case) -> Value:
        tests = [(V.truth(self(t)), self(v)) for t, v in e.whens]
        default = self(e.default) if e.default is not None else null()
        kind = V.common([v.type for _, v in tests] + [default.type]) or STRING
        out = F
        for test, v in tests:
            out = out.when(F.coalesce(test, F.lit(False)), V.widened(v, kind))
        return Value(kind, out.otherwise(V.widened(default, kind)))

    def _call(self, e: A.Call) -> Value:
        if e.name in AGGREGATES:
            raise outside(f"{e.name}()") if not self.extended else QuerySyntaxError(f"InvalidAggregation ({e.name})")
        if e.name in temporal.FUNCTIONS:
            return temporal.FUNCTIONS[e.name]([self(a) for a in e.args])
        if e.name not in LIBRARY:
            raise QuerySyntaxError(f"UnknownFunction ({e.name})")
        return LIBRARY[e.name](self, [self(a) for a in e.args])

    def _items(self, e: A.Expr) -> Value | None:
        if isinstance(e, (A.MapOf, A.Literal)) and not (isinstance(e, A.Literal) and e.value is None):
            raise QuerySyntaxError("InvalidArgumentType")
        v = self(e)
        return v if v.type.name == "list" else None

    def _quantifier(self, e: A.Quantifier) -> Value:
        source = self._items(e.source)
        if source is None:
            return null(BOOL)
        item = source.type.item or V.NULL
        test = lambda x: V.truth(self.inner(**{e.var: Value(item, x)})(e.test))
        if e.kind == "any":
            return Value(BOOL, F.exists(source.col, test))
        if e.kind == "all":
            return Value(BOOL, F.forall(source.col, test))
        if e.kind == "none":
            return Value(BOOL, ~F.exists(source.col, test))
        tests = F.transform(source.col, test)
        sure = F.size(F.filter(tests, lambda t: t))
        open_ = F.exists(tests, lambda t: t.isNull())
        return Value(BOOL, F.when(source.col.isNotNull(), F.when(sure > 1, F.lit(False)).when(~open_, sure == 1)))

    def _reduce(self, e: A.Reduce) -> Value:
        source, start = self._items(e.source), self(e.start)
        if source is None:
            return null()
        item = source.type.item or V.NULL
        kind = start.type
        for _ in range(3):  # the accumulator's type is that of a step at rest
            stepped = self.inner(**{e.acc: Value(kind, F.lit(None)), e.var: Value(item, F.lit(None))})(e.step).type
            wider = V.common([kind, stepped]) or STRING
            if wider == kind:
                break
            kind = wider
        step = lambda acc, x: V.widened(self.inner(**{e.acc: Value(kind, acc), e.var: Value(item, x)})(e.step), kind)
        return Value(kind, F.aggregate(source.col, V.widened(start, kind), step))

    def _comprehension(self, e: A.Comprehension) -> Value:
        source = self._items(e.source)
        if source is None:
            return null(list_of(V.NULL))
        item, col = source.type.item or V.NULL, source.col
        if e.test is not None:
            col = F.filter(col, lambda x: V.truth(self.inner(**{e.var: Value(item, x)})(e.test)))
        if e.out is None:
            return Value(source.type, col)
        kind = self.inner(**{e.var: Value(item, F.lit(None))})(e.out).type
        return Value(list_of(kind), F.transform(col, lambda x: self.inner(**{e.var: Value(item, x)})(e.out).col))

    def _exists(self, e: A.Exists) -> Value:
        if self.exists is None:
            raise QuerySyntaxError("UnexpectedSyntax")
        return self.exists(e)
