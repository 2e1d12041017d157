"""Queries compiled to DataFrames: patterns are joins, clauses their composition.

Only what Spark can't know is decided here - which tables a variable can come from, which
properties the query reads, where a relationship must not repeat - and everything else,
join strategies and orders included, is left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cypher import ast as A
from ..cypher.naming import column_name
from ..errors import QuerySyntaxError, outside
from ..operators import values as V
from ..operators.expressions import AGGREGATES, Compiler, Entity, Scope, ref
from ..operators.values import BOOL, FLOAT, INT, Type, Value, list_of
from ..functions import temporal
from ..sources.catalog import Graph, merged_props
from ..sources.files import scratch_path
from .pairs import paired


def walk(node: object):
    """All dataclass nodes below ``node``, itself included."""
    if isinstance(node, (tuple, list)):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that the plan of a loop doesn't grow."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def used_properties(query: object) -> dict[str, set[str] | None]:
    """The property keys read of each variable; None where the whole entity is."""
    out: dict[str, set[str] | None] = {}
    within: set[int] = set()
    for e in walk(query):
        if isinstance(e, A.Prop) and isinstance(e.base, A.Var):
            within.add(id(e.base))
            if out.get(e.base.name, set()) is not None:
                out.setdefault(e.base.name, set()).add(e.key)
        elif isinstance(e, A.HasLabels) and isinstance(e.arg, A.Var):
            within.add(id(e.arg))
            out.setdefault(e.arg.name, set())
        elif isinstance(e, A.Call) and e.name in ("id", "labels", "type", "startnode", "endnode", "count"):
            for a in e.args:
                if isinstance(a, A.Var):
                    within.add(id(a))
                    out.setdefault(a.name, set())
        elif isinstance(e, (A.Projection,)) and e.star:
            out["*"] = None
        elif isinstance(e, (A.NodePattern, A.RelPattern)) and e.var:
            keys = out.setdefault(e.var, set())
            if keys is not None:
                keys.update(k for k, _ in e.props)
    for e in walk(query):
        if isinstance(e, A.Var) and id(e) not in within:
            out[e.name] = None
    # an endpoint taken as a value is read through its variable, whichever that is
    if any(isinstance(e, A.Call) and e.name in ("startnode", "endnode") for e in walk(query)):
        return dict.fromkeys(out)
    return out


@dataclass
class State:
    df: DataFrame | None = None
    scope: Scope = field(default_factory=Scope)
    order: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    #: Nodes known to be another in every row.
    once: frozenset[str] = frozenset()


class Planner:
    def __init__(self, graph: Graph, params: dict | None = None, extended: bool = False):
        self.graph, self.params, self.extended, self.made = graph, params or {}, extended, 0
        self.used: dict[str, set[str] | None] = {}
        #: What the rows of the patterns at work must meet in the end.
        self.ahead: list[A.Expr] = []
        #: Those of them that a join has seen to: a filter besides would change the keys that its rows are dealt by.
        self.settled: list[A.Expr] = []

    def fresh(self) -> str:
        self.made += 1
        return f"_gen_{self.made}"

    # -- queries

    def query(self, q: A.Query) -> tuple[DataFrame, list[str]]:
        df, steps = self.read(q)
        names = df.columns
        while q.union is not None:
            nxt, every = q.union
            other, more = Planner(self.graph, self.params, self.extended).read(nxt)
            if other.columns != names:
                raise QuerySyntaxError("DifferentColumnsInUnion")
            df = df.unionByName(other)
            steps = [*steps, *more, f"Union(all={every})"]
            if not every:
                df = df.distinct()
            q = nxt
        return df, steps

    def read(self, q: A.Query) -> tuple[DataFrame, list[str]]:
        self.used = used_properties(q.clauses)
        state = State()
        for i, clause in enumerate(q.clauses):
            if isinstance(clause, A.Projection) and clause.final:
                if i != len(q.clauses) - 1:
                    raise QuerySyntaxError("RETURN must be the last clause")
                state = self.project(state, clause)
                return state.df, state.steps
            after = q.clauses[i + 1] if i + 1 < len(q.clauses) else None
            self.ahead = conjuncts(after.expr) if isinstance(clause, A.Match) and not clause.optional and isinstance(after, A.Where) else []
            state = self.clause(state, clause)
        raise QuerySyntaxError("a query that reads must end with RETURN")

    def clause(self, state: State, clause) -> State:
        if isinstance(clause, A.Match):
            return self.match(state, clause)
        if isinstance(clause, A.Where):
            if state.df is None:
                raise QuerySyntaxError("WHERE cannot be the first clause")
            return self.where(state, clause.expr)
        if isinstance(clause, A.Projection):
            return self.project(state, clause)
        if isinstance(clause, A.Unwind):
            return self.unwind(state, clause)
        raise QuerySyntaxError(f"{type(clause).__name__} in a query that reads")

    def compiler(self, state: State) -> Compiler:
        return Compiler(state.scope, self.params, self.extended)

    # -- patterns

    def match(self, state: State, clause: A.Match) -> State:
        self.check_roles(state, clause.patterns)
        if clause.optional:
            return self.optional(state, clause)
        for pattern in clause.patterns:
            state = self.pattern(state, pattern)
        return state

    def check_roles(self, state: State, patterns: tuple[A.Pattern, ...]) -> None:
        roles = {n: e.kind for n, e in state.scope.entities.items()} | dict.fromkeys(state.scope.values, "value")
        for p in patterns:
            for part, role in [(n, "node") for n in p.nodes] + [(r, "rel") for r in p.rels]:
                if part.var and roles.setdefault(part.var, role) != role:
                    raise QuerySyntaxError(f"VariableTypeConflict ({part.var})")

    def pattern(self, state: State, p: A.Pattern) -> State:
        names = [n.var or self.fresh() for n in p.nodes]
        anchor = next((i for i, n in enumerate(names) if n in state.scope.entities), None)
        chain: list[tuple[str, set[str]]] = []
        if anchor is None:
            anchor = self.best_anchor(p)
            state = self.scan(state, p.nodes[anchor], names[anchor], self.reachable(p, anchor))
        else:
            state = self.constrain(state, p.nodes[anchor], names[anchor])
        for i in range(anchor, len(p.rels)):
            state = self.expand(state, p.rels[i], names[i], names[i + 1], p.nodes[i + 1], False, chain)
        for i in range(anchor - 1, -1, -1):
            state = self.expand(state, p.rels[i], names[i + 1], names[i], p.nodes[i], True, chain)
        return state

    def best_anchor(self, p: A.Pattern) -> int:
        return 0

    def reachable(self, p: A.Pattern, at: int) -> set[tuple[str, ...]] | None:
        """Label sets the relationship next to an end of the pattern allows for its node."""
        if not p.rels or at != 0 or p.rels[0].hops and p.rels[0].hops[0] == 0:
            return None
        rel = p.rels[0]
        tables = self.graph.rel_tables(rel.types)
        out: set[tuple[str, ...]] = set()
        for t in tables:
            if rel.direction in ("out", "both"):
                out.add(t.source)
            if rel.direction in ("in", "both"):
                out.add(t.target)
        return out

    def props_of(self, name: str, tables: list, pattern: tuple = ()) -> dict[str, Type]:
        """The properties to carry: those the query or the pattern itself reads."""
        every = merged_props(tables)
        wanted = None if "*" in self.used else self.used.get(name, set())
        return every if wanted is None else {k: t for k, t in every.items() if k in wanted or k in dict(pattern)}

    def node_frame(self, name: str, tables: list, props: dict[str, Type]) -> tuple[DataFrame, Entity]:
        labels = tables[0].labels if len({t.labels for t in tables}) == 1 else None
        entity = Entity("node", name, props, labels=labels)
        rows = self.graph.scan_nodes(tables, props)
        cols = [F.col("id").alias(entity.column("id")), F.col("labels").alias(entity.column("labels"))]
        return rows.select(*cols, *[F.col(f"`{k}`").alias(entity.prop_column(k)) for k in props]), entity

    def tables_for(self, node: A.NodePattern, allowed: set[tuple[str, ...]] | None) -> list:
        tables = self.graph.node_tables(node.labels)
        return tables if allowed is None else [t for t in tables if t.labels in allowed]

    def scan(self, state: State, node: A.NodePattern, name: str, allowed: set[tuple[str, ...]] | None = None) -> State:
        tables = self.tables_for(node, allowed)
        rows, entity = self.node_frame(name, tables, self.props_of(name, tables, node.props))
        scope = state.scope.copy()
        scope.entities[name] = entity
        kind = f"NodeScan({name}{''.join(':' + x for x in node.labels)})"
        if state.df is None:
            df, step, once = rows, kind, frozenset([name])
        else:
            far = State(rows, Scope({name: entity}))
            dealt = self.multiplied(state, far)
            df, step, once = state.df.crossJoin(rows) if dealt is None else dealt, f"CartesianProduct + {kind}", frozenset()
        return self.with_props(State(df, scope, [*state.order, entity.column("id")], [*state.steps, step], once), name, node.props)

    def multiplied(self, left: State, right: State, *keys: tuple[Column, Column]) -> DataFrame | None:
        """The join of rows that may repeat on either side, dealt out by its pairs; None where they are few."""
        ids = [[c for c in self.identity(x) if x.df.schema[c].dataType.typeName() in ("long", "string")] for x in (left, right)]
        also = self.equalities(left, right)
        df = paired(left.df, right.df, [*keys, *also.values()], (self.met(left), self.met(right)), (ids[0], ids[1]), self.fresh())
        if df is not None:
            self.settled += also
        return df

    def met(self, state: State) -> DataFrame:
        """The rows that meet those conditions ahead which read nothing but what is bound."""
        df = state.df
        for part in self.ahead:
            names = {e.name for e in walk(part) if isinstance(e, A.Var)}
            if names and names <= {*state.scope.entities, *state.scope.values} and not any(isinstance(e, A.Exists) for e in walk(part)):
                df = df.filter(V.truth(self.compiler(state)(part)))
        return df

    def equalities(self, left: State, right: State) -> dict[A.Expr, tuple[Column, Column]]:
        """The conditions ahead that make a property of one side equal to one of the other."""
        out = {}
        for part in self.ahead:
            if isinstance(part, A.Binary) and part.op == "=" and all(isinstance(x, A.Prop) and isinstance(x.base, A.Var) for x in (part.left, part.right)):
                for a, b in ((part.left, part.right), (part.right, part.left)):
                    if a.base.name in left.scope.entities and b.base.name in right.scope.entities:
                        x, y = self.compiler(left)(a), self.compiler(right)(b)
                        if x.type.name == y.type.name and x.type.name in ("int", "string"):
                            out[part] = x.col, y.col
        return out

    def constrain(self, state: State, node: A.NodePattern, name: str) -> State:
        """Labels and properties on a variable that is bound."""
        if node.labels:
            labels = ref(state.scope.entities[name].column("labels"))
            test = F.lit(True)
            for x in node.labels:
                test = test & F.array_contains(labels, x)
            state = State(state.df.filter(test), state.scope, state.order, [*state.steps, f"Filter({name}{''.join(':' + x for x in node.labels)})"], state.once)
        return self.with_props(state, name, node.props)

    def with_props(self, state: State, name: str, props: tuple) -> State:
        for key, expr in props:
            state = self.where(state, A.Binary("=", A.Prop(A.Var(name), key), expr))
        return state

    def expand(self, state: State, rel: A.RelPattern, here: str, there: str, node: A.NodePattern, backward: bool, chain: list) -> State:
        if rel.hops:
            return self.expand_many(state, rel, here, there, node, backward)
        if rel.var and rel.var in state.scope.entities:
            return self.bound_rel(state, rel, here, there, node, backward)
        direction = rel.direction if not backward else {"out": "in", "in": "out", "both": "both"}[rel.direction]
        at, to = state.scope.entities[here], state.scope.entities.get(there)
        fits = lambda labels, entity: entity.labels is None or entity.labels == labels
        outward = [t for t in self.graph.rel_tables(rel.types) if direction in ("out", "both") and fits(t.source, at) and (to is None and set(node.labels) <= set(t.target) or to is not None and fits(t.target, to))]
        inward = [t for t in self.graph.rel_tables(rel.types) if direction in ("in", "both") and fits(t.target, at) and (to is None and set(node.labels) <= set(t.source) or to is not None and fits(t.source, to))]
        name = rel.var or self.fresh()
        tables = list({id(t): t for t in [*outward, *inward]}.values())
        props = self.props_of(name, tables, rel.props)
        entity = Entity("rel", name, props, tuple(dict.fromkeys(t.type for t in tables)))
        entity.ends = (here, there) if (rel.direction != "in") != backward else (there, here)
        near, far = f"{name}|near", f"{name}|far"

        def edges(tables: list, near_end: str, far_end: str, loops: bool) -> DataFrame:
            rows = self.graph.scan_rels(tables, props)
            rows = rows if loops else rows.filter("src <> dst")
            cols = [F.col(c).alias(entity.column(c)) for c in ("src", "type", "dst")]
            return rows.select(F.col(near_end).alias(near), F.col(far_end).alias(far), *cols, *[F.col(f"`{k}`").alias(entity.prop_column(k)) for k in props])

        parts = []
        if direction in ("out", "both"):
            parts.append(edges(outward, "src", "dst", True))
        if direction in ("in", "both"):
            parts.append(edges(inward, "dst", "src", direction == "in"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        scope = state.scope.copy()
        scope.entities[name] = entity
        step = f"Expand({here}{'<' * (direction == 'in')}-[{name}{':' + '|'.join(rel.types) if rel.types else ''}]-{'>' * (direction == 'out')}{there})"
        order = [*state.order, entity.column("type"), far]
        ends = {t.target for t in outward} | {t.source for t in inward}
        single = all("src" in t.single for t in outward) and all("dst" in t.single for t in inward)
        once = frozenset()
        if len(outward) + len(inward) == 1:
            back = all("dst" in t.single for t in outward) and all("src" in t.single for t in inward)
            once = (state.once if single else once) | ({there} if back and here in state.once else once)
        dealt = None
        if to is None and not single and here not in state.once:
            right = self.arrive(State(rows, Scope({name: entity}), [], []), far, there, node, ends, False)
            dealt = self.multiplied(state, right, (ref(at.column("id")), ref(near)))
        if dealt is None:
            df = state.df.join(rows, ref(at.column("id")) == ref(near))
            state = self.arrive(State(df, scope, order, [*state.steps, step], once), far, there, node, ends)
        else:
            scope.entities[there] = right.scope.entities[there]
            state = self.with_props(State(dealt, scope, order, [*state.steps, step], once), there, node.props)
        state = self.with_props(state, name, rel.props)
        return self.unrepeated(state, name, entity, chain)

    def arrive(self, state: State, far: str, there: str, node: A.NodePattern, ends: set[tuple[str, ...]], whole: bool = True) -> State:
        """Bind the far end of an expansion: to a variable that is bound, or to its own tables.  ``whole``: with the pattern's properties."""
        if there in state.scope.entities:
            df = state.df.filter(ref(far) == ref(state.scope.entities[there].column("id")))
            return self.constrain(State(df, state.scope, state.order, state.steps, state.once), node, there)
        tables = self.tables_for(node, ends)
        props = self.props_of(there, tables, node.props)
        scope = state.scope.copy()
        if not props and not node.props and {t.labels for t in tables} == ends and len(ends) == 1:
            # nothing is read of the node, and the relationship's table says which labels it has
            entity = Entity("node", there, {}, labels=tables[0].labels, scanned=False)
            df = state.df.withColumn(entity.column("id"), ref(far)).withColumn(entity.column("labels"), F.array(*map(F.lit, tables[0].labels)))
        else:
            rows, entity = self.node_frame(there, tables, props)
            df = state.df.join(rows, ref(far) == ref(entity.column("id")))
        scope.entities[there] = entity
        return self.with_props(State(df, scope, state.order, state.steps, state.once), there, node.props if whole else ())

    def unrepeated(self, state: State, name: str, entity: Entity, chain: list) -> State:
        """A pattern takes a relationship once; those of other types can't be the same."""
        df = state.df
        for other, types in chain:
            if types & set(entity.types):
                o = state.scope.entities[other]
                same = F.lit(True)
                for c in ("src", "type", "dst"):
                    same = same & (ref(o.column(c)) == ref(entity.column(c)))
                df = df.filter(~same)
        chain.append((name, set(entity.types)))
        return State(df, state.scope, state.order, state.steps, state.once)

    def bound_rel(self, state: State, rel: A.RelPattern, here: str, there: str, node: A.NodePattern, backward: bool) -> State:
        """The relationship is known: its ends decide, no table is read for it."""
        e = state.scope.entities[rel.var]
        direction = rel.direction if not backward else {"out": "in", "in": "out", "both": "both"}[rel.direction]
        src, dst, at = ref(e.column("src")), ref(e.column("dst")), ref(state.scope.entities[here].column("id"))
        far = self.fresh() + "|far"
        if direction == "both":
            df = state.df.withColumn(far, F.when(src == at, dst).when(dst == at, src)).filter(ref(far).isNotNull())
        else:
            near, other = (src, dst) if direction == "out" else (dst, src)
            df = state.df.filter(near == at).withColumn(far, other)
        if rel.types:
            df = df.filter(ref(e.column("type")).isin(*rel.types))
        state = State(df, state.scope, state.order, [*state.steps, f"BoundRelationship({rel.var})"])
        ends = {t.labels for t in self.graph.nodes}
        return self.with_props(self.arrive(state, far, there, node, ends), rel.var, rel.props)

    def expand_many(self, state: State, rel: A.RelPattern, here: str, there: str, node: A.NodePattern, backward: bool) -> State:
        """Bounded unrolling: one branch for each number of hops, no relationship twice in a path."""
        low, high = rel.hops
        if rel.var:
            raise outside("a variable for a variable-length relationship")
        if high is None:
            return self.expand_all(state, rel, here, there, node, backward)
        branches = []
        for n in range(low, high + 1):
            sub = State(state.df, state.scope.copy(), list(state.order), list(state.steps))
            if n == 0:
                if there in sub.scope.entities:
                    sub.df = sub.df.filter(ref(sub.scope.entities[here].column("id")) == ref(sub.scope.entities[there].column("id")))
                else:
                    tmp = f"{here}|far0"
                    sub.df = sub.df.withColumn(tmp, ref(sub.scope.entities[here].column("id")))
                    sub = self.arrive(sub, tmp, there, node, {t.labels for t in self.graph.nodes})
            else:
                chain: list = []
                at = here
                for k in range(n):
                    nxt = there if k == n - 1 else self.fresh()
                    sub = self.expand(sub, A.RelPattern(None, rel.types, rel.props, rel.direction), at, nxt, node if k == n - 1 else A.NodePattern(None, (), ()), backward, chain)
                    at = nxt
            branches.append(sub)
        kept = list(state.df.columns)
        tables = self.tables_for(node, None)
        props = self.props_of(there, tables, node.props)
        entity = state.scope.entities.get(there) or Entity("node", there, props)
        new = [] if there in state.scope.entities else [entity.column("id"), entity.column("labels"), *[entity.prop_column(k) for k in entity.props]]
        out = None
        for sub in branches:
            cols = [ref(c).alias(c) if c in sub.df.columns else F.lit(None).cast(V.spark_type(props[c.split(".", 1)[1]])).alias(c) for c in new]
            rows = sub.df.select(*[ref(c) for c in kept], *cols)
            out = rows if out is None else out.unionByName(rows)
        scope = state.scope.copy()
        scope.entities[there] = entity
        return State(out, scope, [*state.order, entity.column("id")], [*state.steps, f"ExpandMany({here}-[*{low}..{high}]-{there})"])

    def expand_all(self, state: State, rel: A.RelPattern, here: str, there: str, node: A.NodePattern, backward: bool) -> State:
        """No upper bound: hop after hop, each checkpointed, until one adds no path.

        A path takes a relationship once, so the rounds end on every graph.
        """
        kept, low, cur = list(state.df.columns), rel.hops[0], self.fresh()
        at, path = f"{cur}|at", f"{cur}|path"
        entity = Entity("node", cur, {})
        scope = state.scope.copy()
        scope.entities[cur] = entity
        none = F.array().cast("array<struct<src:bigint,type:string,dst:bigint>>")
        paths = state.df.select(*map(ref, kept), ref(state.scope.entities[here].column("id")).alias(entity.column("id")), none.alias(path))
        found, n = None, 0
        while True:
            if n >= low:
                rows = paths.select(*map(ref, kept), ref(entity.column("id")).alias(at))
                found = rows if found is None else found.unionByName(rows)
            chain: list = []
            nxt = self.fresh()
            hop = self.expand(State(paths, scope.copy(), [], []), A.RelPattern(None, rel.types, rel.props, rel.direction), cur, nxt, A.NodePattern(None, (), ()), backward, chain)
            edge = hop.scope.entities[chain[-1][0]]
            src, kind, dst = (ref(edge.column(c)) for c in ("src", "type", "dst"))
            step = F.struct(src.alias("src"), kind.alias("type"), dst.alias("dst"))
            again = F.array_contains(ref(path), step)
            longer = F.concat(ref(path), F.array(step)).alias(path)
            far = ref(hop.scope.entities[nxt].column("id")).alias(entity.column("id"))
            paths, n = checkpointed(hop.df.filter(~again).select(*map(ref, kept), far, longer)), n + 1
            if paths.isEmpty():
                break
        if found is None:
            found = paths.select(*map(ref, kept), ref(entity.column("id")).alias(at))
        out = self.arrive(State(found, state.scope, state.order, state.steps), at, there, node, {t.labels for t in self.graph.nodes})
        return State(out.df.drop(at), out.scope, [*state.order, out.scope.entities[there].column("id")], [*state.steps, f"ExpandAll({here}-[*{low}..]-{there})"])

    def optional(self, state: State, clause: A.Match) -> State:
        """OPTIONAL MATCH: the pattern's rows, or one with nulls."""
        if state.df is None:
            state = State(self.graph.spark.range(1).select(), Scope(), [], ["ReturnOne"])
        at = self.hinge(state, clause.patterns, clause.where)
        keys = [state.scope.entities[at].column("id")] if at else self.identity(state)
        inner = self.inner(state, clause.patterns, clause.where, at, keys)
        fresh = [c for n, e in inner.scope.entities.items() if n not in state.scope.entities for c in self.columns_of(inner, n)] if at else [c for c in inner.df.columns if c not in state.df.columns]
        right = inner.df.select(*[ref(k).alias(f"{k}|other") for k in keys], *map(ref, fresh))
        df = state.df.join(right, self.same(keys, bool(at)), "left").drop(*[f"{k}|other" for k in keys])
        scope = inner.scope
        if at:
            scope = state.scope.copy()
            scope.entities |= {n: e for n, e in inner.scope.entities.items() if n not in scope.entities}
        return State(df, scope, [*state.order, *[c for c in inner.order if c in fresh]], [*state.steps, f"Optional({', '.join(inner.steps)})"])

    def hinge(self, state: State, patterns: tuple, where: A.Expr | None) -> str | None:
        """The one bound node through which a pattern hangs on the rows before it, if nothing else ties them."""
        if len(patterns) != 1:
            return None
        p = patterns[0]
        names = [n.var for n in p.nodes if n.var] + [r.var for r in p.rels if r.var]
        bound = [n for n in names if n in state.scope.entities or n in state.scope.values]
        read = {e.name for e in walk((patterns, where)) if isinstance(e, A.Var)}
        free = {e.var for e in walk((patterns, where)) if isinstance(e, (A.NodePattern, A.RelPattern)) and e.var}
        outer = (read | free) & {*state.scope.entities, *state.scope.values}
        if len(bound) == 1 and outer <= set(bound) and bound[0] in {n.var for n in p.nodes} and state.scope.entities[bound[0]].kind == "node":
            return bound[0]
        return None

    def inner(self, state: State, patterns: tuple, where: A.Expr | None, at: str | None, keys: list[str]) -> State:
        """The patterns' rows: by themselves, where they hang on one node, or from the distinct bindings of the rows before."""
        out = State() if at else State(state.df.dropDuplicates(keys) if keys else state.df.limit(1), state.scope, state.order, [])
        self.ahead = [] if where is None else conjuncts(where)
        for p in patterns:
            out = self.pattern(out, p)
        self.ahead = []
        return out if where is None else self.where(out, where)

    def identity(self, state: State) -> list[str]:
        """The columns that tell the bindings of a row; equal ones have equal matches."""
        out = []
        for e in state.scope.entities.values():
            out += [e.column("id")] if e.kind == "node" else [e.column(x) for x in ("src", "type", "dst")]
        return out + [f"{n}|value" for n in state.scope.values if f"{n}|value" in state.df.columns]

    def same(self, keys: list[str], plain: bool = False) -> Column:
        """``plain``: a null matches nothing."""
        test = F.lit(True)
        for k in keys:
            other = ref(f"{k}|other")
            test = test & (ref(k) == other if plain else ref(k).eqNullSafe(other))
        return test

    # -- filters

    def where(self, state: State, expr: A.Expr) -> State:
        for part in conjuncts(expr):
            if not any(part is x for x in self.settled):
                state = self.where_one(state, part)
        return state

    def where_one(self, state: State, expr: A.Expr) -> State:
        negated = isinstance(expr, A.Unary) and expr.op == "NOT" and isinstance(expr.arg, A.Exists)
        found = expr.arg if negated else expr
        if isinstance(found, A.Exists):
            return self.exists(state, found, negated)
        v = self.compiler(state)(expr)
        if v.type.name in ("node", "rel"):
            raise QuerySyntaxError("InvalidArgumentType")
        return State(state.df.filter(V.truth(v)), state.scope, state.order, [*state.steps, "Filter"], state.once)

    def exists(self, state: State, e: A.Exists, negated: bool) -> State:
        self.check_roles(state, e.patterns)
        at = self.hinge(state, e.patterns, e.where)
        keys = [state.scope.entities[at].column("id")] if at else self.identity(state)
        inner = self.inner(state, e.patterns, e.where, at, keys)
        right = inner.df.select(*[ref(k).alias(f"{k}|other") for k in keys])
        right = right if at else right.distinct()
        df = state.df.join(right, self.same(keys, bool(at)), "left_anti" if negated else "left_semi")
        return State(df, state.scope, state.order, [*state.steps, "AntiJoin" if negated else "SemiJoin"])

    def unwind(self, state: State, clause: A.Unwind) -> State:
        df = self.graph.spark.range(1).select() if state.df is None else state.df
        v = self.compiler(state)(clause.expr)
        if v.type.name == "null":
            v = Value(list_of(V.STRING), F.array().cast("array<string>"))
        item = v.type.item if v.type.name == "list" else v.type
        col = f"{clause.var}|value"
        source = v.col if v.type.name == "list" else F.array(v.col)
        df = df.select(*map(ref, df.columns), F.posexplode(source).alias(col + "at", col))
        scope = state.scope.copy()
        scope.values[clause.var] = Value(item or V.NULL, ref(col))
        return State(df, scope, [*state.order, col + "at"], [*state.steps, f"Unwind({clause.var})"])

    # -- projection

    def constant(self, expr: A.Expr, what: str) -> int:
        for e in walk(expr):
            if isinstance(e, (A.Var, A.Call)):
                raise QuerySyntaxError(f"NonConstantExpression ({what})")
        v = fold(expr, self.params)
        if isinstance(v, bool) or not isinstance(v, int):
            raise QuerySyntaxError(f"InvalidArgumentType ({what})")
        if v < 0:
            raise QuerySyntaxError(f"NegativeIntegerArgument ({what})")
        return v

    def project(self, state: State, p: A.Projection) -> State:
        if state.df is None:
            state = State(self.graph.spark.range(1).select(), Scope(), [], ["ReturnOne"])
        items = list(p.items)
        if p.star:
            names = sorted(state.scope.names())
            if not names:
                raise QuerySyntaxError("NoVariablesInScope")
            items = [A.Item(A.Var(n), n) for n in names] + items
        named = [(i.alias or column_name(i.expr, k), i.expr) for k, i in enumerate(items)]
        if len({n for n, _ in named}) != len(named):
            raise QuerySyntaxError("ColumnNameConflict")
        grouped = any(isinstance(e, A.Call) and e.name in AGGREGATES for _, x in named for e in walk(x))
        if grouped and not self.extended:
            raise outside("aggregation")
        state = self.grouped(state, named) if grouped else self.plain(state, named, p.final and not (p.distinct or p.order))
        return self.finish(state, p, [n for n, _ in named], named)

    def plain(self, state: State, named: list[tuple[str, A.Expr]], last: bool) -> State:
        c = self.compiler(state)
        scope, values = Scope(), {}
        for name, expr in named:
            v = c(expr)
            if v.type.name in ("node", "rel") and isinstance(expr, A.Var):
                scope.entities[name] = renamed(state.scope.entities[expr.name], name)
                values[name] = ("entity", expr.name)
            elif v.type.name in ("node", "rel"):
                values[name] = ("value", Value(V.STRING, F.to_json(c.struct(v))))
                scope.values[name] = Value(V.STRING, ref(f"{name}|value"))
            else:
                values[name] = ("value", v)
                scope.values[name] = Value(v.type, ref(f"{name}|value"))
        cols = []
        for name, (kind, v) in values.items():
            if kind == "value":
                cols.append((f"{name}|value", v.col if v.type.name != "null" else F.lit(None).cast("string")))
            else:
                old, new = state.scope.entities[v], scope.entities[name]
                parts = ("id", "labels") if old.kind == "node" else ("src", "type", "dst")
                cols += [(new.column(x), ref(old.column(x))) for x in parts]
                cols += [(new.prop_column(k), ref(old.prop_column(k))) for k in old.props]
        taken = {n for n, _ in cols}
        order = [f"{i}|order" for i in range(len(state.order))]
        hidden = [ref(c).alias(o) for c, o in zip(state.order, order, strict=True)]
        # columns that ORDER BY may still read under their old names
        rest = [ref(c) for c in state.df.columns if c not in taken]
        df = state.df.select(*[x.alias(n) for n, x in cols], *hidden, *rest)
        merged = Scope({**{k: v for k, v in state.scope.entities.items() if k not in scope.entities and k not in scope.values}, **scope.entities}, {**{k: v for k, v in state.scope.values.items() if k not in scope.values and k not in scope.entities}, **scope.values})
        return State(df, merged, order, [*state.steps, f"Project({', '.join(n for n, _ in named)})"])

    def grouped(self, state: State, named: list[tuple[str, A.Expr]]) -> State:
        """Items without an aggregate are the grouping keys."""
        c = self.compiler(state)
        keys, sums, scope = [], [], Scope()
        made: list[Column] = []
        for name, expr in named:
            calls = [e for e in walk(expr) if isinstance(e, A.Call) and e.name in AGGREGATES]
            if not calls:
                v = c(expr)
                if v.type.name in ("node", "rel") and isinstance(expr, A.Var):
                    old = state.scope.entities[expr.name]
                    new = scope.entities[name] = renamed(old, name)
                    parts = ("id", "labels") if old.kind == "node" else ("src", "type", "dst")
                    keys += [ref(old.column(x)).alias(new.column(x)) for x in parts] + [ref(old.prop_column(k)).alias(new.prop_column(k)) for k in old.props]
                else:
                    keys.append((v.col if v.type.name != "null" else F.lit(None).cast("string")).alias(f"{name}|value"))
                    scope.values[name] = Value(v.type, ref(f"{name}|value"))
            else:
                agg = AggregateCompiler(state.scope, self.params, self.extended)
                agg.made = made
                v = agg(expr)
                sums.append(v.col.alias(f"{name}|value"))
                scope.values[name] = Value(v.type, ref(f"{name}|value"))
        rows = state.df.select("*", *made) if made else state.df
        df = rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)
        return State(df, scope, [], [*state.steps, f"Aggregate({', '.join(n for n, _ in named)})"])

    def finish(self, state: State, p: A.Projection, names: list[str], named: list) -> State:
        df, steps = state.df, list(state.steps)
        by = {expr: name for name, expr in named}
        sort: list[Column] = []
        for expr, up in p.order:
            v = self.compiler(state)(A.Var(by[expr]) if expr in by else expr)
            sort.append(v.col.asc_nulls_last() if up else v.col.desc_nulls_first())
        if p.distinct:
            df = df.select(*[ref(c) for n in names for c in self.columns_of(state, n)]).distinct()
            steps.append("Distinct")
        ties = [] if p.distinct else [ref(c) for c in state.order]
        limit = None if p.limit is None else self.constant(p.limit, "LIMIT")
        skip = None if p.skip is None else self.constant(p.skip, "SKIP")
        if sort or limit is not None or skip is not None:
            if not sort and not ties:
                ties = [ref(c) for n in names for c in self.columns_of(state, n)[:1]]
            df = df.orderBy(*sort, *ties)
            if skip:
                df = df.offset(skip)
                steps.append(f"Skip({skip})")
            if limit is not None:
                df = df.limit(limit)
                steps.append(f"Limit({limit})")
        if p.final:
            c = Compiler(state.scope, self.params, self.extended)
            return State(df.select(*[self.output(c, n).alias(n) for n in names]), Scope(), [], steps)
        keep = Scope({n: state.scope.entities[n] for n in names if n in state.scope.entities}, {n: state.scope.values[n] for n in names if n in state.scope.values})
        order = [] if p.distinct or sort else state.order
        df = df.select(*[ref(c) for n in names for c in self.columns_of(state, n)], *[ref(c) for c in order])
        fresh = [f"{self.fresh()}|order" for _ in order]
        for a, b in zip(order, fresh, strict=True):
            df = df.withColumnRenamed(a, b)
        return State(df, keep, fresh, steps)

    def columns_of(self, state: State, name: str) -> list[str]:
        if name in state.scope.entities:
            e = state.scope.entities[name]
            parts = ("id", "labels") if e.kind == "node" else ("src", "type", "dst")
            return [e.column(x) for x in parts] + [e.prop_column(k) for k in e.props]
        return [f"{name}|value"]

    def output(self, c: Compiler, name: str) -> Column:
        v = c.variable(name)
        if v.type.name in ("node", "rel"):
            return c.struct(v)
        if v.type.name in V.TEMPORAL and v.type.name != "localdatetime" or v.type.name == "duration":
            return temporal.to_text(v)
        if v.type.name == "localdatetime":
            return temporal.to_text(v)
        if v.type.name == "list" and v.type.item and (v.type.item.name in V.TEMPORAL or v.type.item.name == "duration"):
            item = v.type.item
            return F.transform(v.col, lambda x: temporal.to_text(Value(item, x)))
        return v.col


def renamed(e: Entity, name: str) -> Entity:
    return Entity(e.kind, name, e.props, e.types, e.labels, e.scanned, e.ends)


def conjuncts(e: A.Expr) -> list[A.Expr]:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, A.Binary) and e.op == "AND" else [e]


def fold(e: A.Expr, params: dict) -> object:
    """A constant expression's Python value."""
    if isinstance(e, A.Literal):
        return e.value
    if isinstance(e, A.Param):
        return params.get(e.name)
    if isinstance(e, A.Unary) and e.op == "-":
        v = fold(e.arg, params)
        return -v if isinstance(v, (int, float)) else None
    if isinstance(e, A.Binary) and e.op in ("+", "-", "*", "/", "%"):
        a, b = fold(e.left, params), fold(e.right, params)
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            if e.op in "+-*":
                return {"+": a + b, "-": a - b, "*": a * b}[e.op]
            if b:
                q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
                return (q if isinstance(a, int) and isinstance(b, int) else a / b) if e.op == "/" else a - b * q
    return None


class AggregateCompiler(Compiler):
    """Expressions over aggregates; ``made``: columns that aggregates ask for by name."""

    made: list[Column]

    def _call(self, e: A.Call) -> Value:
        if e.name not in AGGREGATES:
            return super()._call(e)
        if e.star:
            return Value(INT, F.count(F.lit(1)))
        plain = Compiler(self.scope, self.params, self.extended)
        v = plain(e.args[0])
        col = plain.struct(v) if v.type.name in ("node", "rel") and e.name == "collect" else v.col
        if e.name == "count":
            return Value(INT, F.count_distinct(col) if e.distinct else F.count(col))
        if e.name == "collect":
            return Value(list_of(v.type if v.type.name not in ("node", "rel") else V.STRING), F.array_sort(F.collect_set(col)) if e.distinct else F.collect_list(col))
        if e.name in ("min", "max"):
            return Value(v.type, getattr(F, e.name)(col))
        if not v.type.number and v.type.name != "null":
            raise QuerySyntaxError(f"InvalidArgumentType ({e.name})")
        if e.name == "sum":
            return Value(v.type, F.coalesce(F.sum_distinct(col) if e.distinct else F.sum(col), F.lit(0).cast(V.spark_type(v.type))))
        if e.name == "avg":
            return Value(FLOAT, F.avg(col) if not e.distinct else F.sum_distinct(col) / F.count_distinct(col))
        if e.name in ("stdev", "stdevp"):
            return Value(FLOAT, (F.stddev_samp if e.name == "stdev" else F.stddev_pop)(col))
        share = plain(e.args[1])
        if not share.is_const:
            raise QuerySyntaxError(f"NonConstantExpression ({e.name})")
        if e.name == "percentilecont":
            return Value(FLOAT, F.percentile(col, F.lit(float(share.const))))
        name = f"{e.name}|{len(self.made)}"
        self.made.append(col.alias(name))
        return Value(v.type, F.expr(f"percentile_disc({float(share.const)!r}) within group (order by `{name}`)").cast(V.spark_type(v.type)))


__all__ = ["BOOL", "Planner", "State", "conjuncts", "fold", "used_properties", "walk"]
