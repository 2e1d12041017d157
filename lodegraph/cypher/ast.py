"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    base: Expr
    key: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class HasLabels(Expr):
    arg: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    base: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    test: Expr


@dataclass(frozen=True)
class Reduce(Expr):
    acc: str
    start: Expr
    var: str
    source: Expr
    step: Expr


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    test: Expr | None
    out: Expr | None


@dataclass(frozen=True)
class Exists(Expr):
    patterns: tuple[Pattern, ...]
    where: Expr | None


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...]
    props: tuple[tuple[str, Expr], ...]
    direction: str  # "out", "in" or "both"
    hops: tuple[int, int | None] | None = None


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class Match:
    patterns: tuple[Pattern, ...]
    optional: bool = False
    where: Expr | None = None  # of an optional match: what its rows must meet


@dataclass(frozen=True)
class Where:
    expr: Expr


@dataclass(frozen=True)
class Projection:
    """RETURN, or WITH where ``final`` is false."""

    items: tuple[Item, ...]
    star: bool
    final: bool
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass(frozen=True)
class Unwind:
    expr: Expr
    var: str


@dataclass(frozen=True)
class Create:
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class SetProps:
    items: tuple[tuple[str, str, Expr], ...]


@dataclass(frozen=True)
class Delete:
    exprs: tuple[Expr, ...]
    detach: bool


@dataclass
class Query:
    clauses: list = field(default_factory=list)
    explain: bool = False
    union: tuple[Query, bool] | None = None  # the query after UNION, and whether ALL
