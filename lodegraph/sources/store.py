"""Graphs kept as versioned Parquet tables, and the transactions that change them.

A graph is a folder with ``manifest.json``, which names the tables of the current version, and one folder for
each commit.  A table is one or more Parquet folders.  A commit adds folders with the new rows, writes only those tables anew
in which rows changed or went, carries all others over, and then publishes its manifest: the file of a version
number is made only if no one else has made it, and ``manifest.json`` is replaced in one step, so a reader sees all of a
version or nothing of it; earlier versions stay readable until :meth:`Store.vacuum`.  One writer at a time holds ``writer.lock``, which names
its owner and when its lease ends, so that the lock of a lost driver falls.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..cypher.parser import parse
from ..errors import Conflict, Duplicate, NotFound, QueryRuntimeError, QuerySyntaxError, StorageError
from ..operators import values as V
from ..operators.expressions import Compiler, Scope, ref
from ..operators.values import Value
from ..plans.planner import Planner, State
from .catalog import EXT, Graph, NodeTable, RelTable
from .files import Folder, scratch_path

FORMAT = 2
MANIFEST, LOCK = "manifest.json", "writer.lock"
#: Folders of a table before a commit writes it as one, seconds of a writer's lease, rows that may be sent to all tasks.
MAX_PARTS, LEASE, FEW = 32, 3600, 1_000_000


class Store:
    """A stored graph; :meth:`graph` is a snapshot of its current (or a given) version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, str(path).rstrip("/"), Folder(spark, str(path))

    @staticmethod
    def create(spark: SparkSession, path: str) -> Store:
        store = Store(spark, path)
        if store.files.exists(MANIFEST):
            raise StorageError(f"{path} holds a graph already")
        store.files.make()
        store._publish({"format": FORMAT, "version": 0, "next_id": 0, "next_ext": 1, "labels": [], "types": [], "nodes": [], "rels": []})
        return store

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        """Open a graph, or make an empty one."""
        store = Store(spark, path)
        if not store.files.exists(MANIFEST):
            return Store.create(spark, path)
        store.manifest()
        return store

    def manifest(self, version: int | None = None) -> dict:
        name = MANIFEST if version is None else f"manifest-{version}.json"
        try:
            found = json.loads(self.files.read(name))
        except FileNotFoundError:
            raise NotFound(f"{self.path} has no version {version}" if version is not None else f"{self.path} holds no graph") from None
        except ValueError as e:
            raise StorageError(f"{self.path}/{name} can't be read: {e}") from e
        if found.get("format") != FORMAT:
            raise StorageError(f"format {found.get('format')} is not {FORMAT}")
        return found

    def _publish(self, manifest: dict) -> None:
        text = json.dumps(manifest)
        if not self.files.create(f"manifest-{manifest['version']}.json", text):
            raise Conflict(f"version {manifest['version']} of {self.path} is another writer's")
        self.files.replace(MANIFEST, text)

    def _caught_up(self) -> dict:
        """The current manifest; a version that its writer made but didn't put in place is put there."""
        m = self.manifest()
        while self.files.exists(f"manifest-{m['version'] + 1}.json"):
            m = self.manifest(m["version"] + 1)
            self.files.replace(MANIFEST, json.dumps(m))
        return m

    def _frame(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(*[f"{self.path}/{x}" for x in entry["paths"]])

    def node_table(self, entry: dict) -> NodeTable:
        return NodeTable(tuple(entry["labels"]), self._frame(entry), EXT, tuple(entry["ids"]) if entry.get("ids") else None)

    def rel_table(self, entry: dict) -> RelTable:
        return RelTable(entry["type"], tuple(entry["source"]), tuple(entry["target"]), self._frame(entry))

    def _graph(self, m: dict) -> Graph:
        return Graph(self.spark, [self.node_table(e) for e in m["nodes"]], [self.rel_table(e) for e in m["rels"]], (tuple(m["labels"]), tuple(m["types"])))

    def graph(self, version: int | None = None) -> Graph:
        return self._graph(self.manifest(version))

    def checkpoint(self) -> int:
        """Write tables of several folders as one; returns the version, a new one if there was something to do."""
        with self.begin() as t:
            return t.compact()

    def close(self) -> None:
        """Every commit is on disk already: nothing is left to be written."""

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but the newest ``keep``, and what no kept version and no writer needs; returns how many things went."""
        with self.begin() as t:
            versions = range(max(0, t.manifest["version"] - keep + 1), t.manifest["version"] + 1)
            kept = [self.manifest(v) for v in versions if self.files.exists(f"manifest-{v}.json")] + [t.manifest]
            used = {x.split("/")[0] for m in kept for e in [*m["nodes"], *m["rels"]] for x in e["paths"]}
            used |= {MANIFEST, LOCK, *[f"manifest-{v}.json" for v in versions]}
            gone = [x for x in self.files.names() if x not in used]
            for x in gone:
                self.files.delete(x)
            return len(gone)

    def begin(self) -> Transaction:
        return Transaction(self)

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        from ..session import Session

        return Session(self.graph()).query(text, params)

    def execute(self, text: str, params: dict | None = None) -> int:
        """One statement that writes, in a transaction of its own."""
        with self.begin() as t:
            count = t.run(text, params)
            t.commit()
        return count


def scratch_store(spark: SparkSession) -> Store:
    return Store.create(spark, scratch_path(spark, "graph"))


NUMBER = "create|row"
#: Kinds of property values that are gathered in columns.
PLAIN = {bool: pa.bool_(), int: pa.int64(), float: pa.float64(), str: pa.string()}
ARROW = {T.LongType: pa.int64(), T.StringType: pa.string()}


@dataclass
class NodeRow:
    id: int
    ext: int
    labels: tuple[str, ...]
    props: dict = field(default_factory=dict)


class Transaction:
    """Staged changes against the version current at its begin; leaving it without commit rolls back.

    Statements read that version: a transaction doesn't see its own changes.  The typed methods gather single entities
    on the driver, which become one frame for each set of labels, type and kinds of properties; :meth:`run`, :meth:`create_nodes` and
    :meth:`create_edges` stage whole DataFrames.  The ends of new relationships are looked up together at the commit.
    """

    def __init__(self, store: Store):
        self.store, self.spark, self.owner = store, store.spark, uuid.uuid4().hex
        self._lock()
        self.open = True
        self.manifest = store._caught_up()
        self.graph = store._graph(self.manifest)
        self.base, self.base_rels = self.graph.nodes, self.graph.rels
        self.next_id, self.next_ext = self.manifest["next_id"], self.manifest["next_ext"]
        self.new_nodes: dict[int, NodeRow] = {}
        self.new_ext: set[int] = set()
        self.new_edges: dict[tuple[int, str, int], dict] = {}
        self.new_sets: dict[tuple[int, str], object] = {}
        self.node_frames: list[tuple[tuple[str, ...], DataFrame]] = []
        self.edge_frames: list[tuple[str, DataFrame]] = []
        self.bulk_ext: list[DataFrame] = []
        self.node_sets: list[DataFrame] = []  # (id, set:key...)
        self.edge_sets: list[DataFrame] = []
        self.dead_nodes: list[DataFrame] = []
        self.dead_edges: list[DataFrame] = []
        self.label_changes: dict[int, list[tuple[str, bool]]] = {}
        self.removed: set[tuple[int, str]] = set()
        self.seen: dict[int, bool] = {}
        self.folder = f"v{self.manifest['version'] + 1}-{self.owner[:8]}"
        self.staged = f"staged-{self.owner[:8]}"
        self.kept = False

    def _lock(self) -> None:
        mine = json.dumps({"owner": self.owner, "until": time.time() + LEASE})
        files = self.store.files
        if files.create(LOCK, mine):
            return
        try:
            until = json.loads(files.read(LOCK))["until"]
        except (FileNotFoundError, ValueError, KeyError):
            until = float("inf")
        if until < time.time():
            files.delete(LOCK)  # should two writers do this at once, only one can publish
            if files.create(LOCK, mine):
                return
        raise Conflict(f"{self.store.path} is being written")

    def renew(self) -> None:
        """Begin the lease anew, for transactions that take long."""
        self._owned()
        self.store.files.replace(LOCK, json.dumps({"owner": self.owner, "until": time.time() + LEASE}))

    def _owned(self) -> None:
        try:
            if json.loads(self.store.files.read(LOCK))["owner"] == self.owner:
                return
        except (FileNotFoundError, ValueError, KeyError):
            pass
        raise Conflict(f"the lease on {self.store.path} has ended")

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_: object) -> None:
        self.rollback()

    def rollback(self) -> None:
        if self.open:
            self.open = False
            self.store.files.delete(self.staged)
            if not self.kept:
                self.store.files.delete(self.folder)
            try:
                self._owned()
            except Conflict:
                return
            self.store.files.delete(LOCK)

    # -- the typed interface

    def get_or_create_label(self, name: str) -> int:
        """A label's number; a new one is published at once and stays, whatever becomes of the transaction."""
        return self._numbered("labels", name)

    def get_or_create_type(self, name: str) -> int:
        return self._numbered("types", name)

    def _numbered(self, kind: str, name: str) -> int:
        if name not in self.manifest[kind]:
            self._owned()
            m = self.manifest | {kind: [*self.manifest[kind], name], "version": self.manifest["version"] + 1}
            self.store._publish(m)
            self.manifest = m
        return self.manifest[kind].index(name)

    def _known_ext(self, ext: int) -> bool:
        # all external ids of the version are below its next one
        return ext in self.new_ext or ext < self.manifest["next_ext"] and self.graph.lookup_internal_id(ext) is not None

    def _live(self, node: int) -> bool:
        if node in self.new_nodes:
            return True
        if node not in self.seen:
            self.seen[node] = 0 <= node < self.manifest["next_id"] and self.graph._node(node) is not None
        return self.seen[node]

    def create_node(self, ext: int, label: str | tuple[str, ...] = ()) -> int:
        if ext == 0 or self._known_ext(ext):
            raise Duplicate(f"external id {ext}")
        labels = (label,) if isinstance(label, str) else tuple(label)
        node, self.next_id = self.next_id, self.next_id + 1
        self.new_nodes[node] = NodeRow(node, ext, labels)
        self.new_ext.add(ext)
        return node

    def create_edge(self, src: int, rel: str, dst: int) -> None:
        """Stage a relationship; an end that can't be a node is refused here, one that was deleted at the commit."""
        for end in (src, dst):
            if end not in self.new_nodes and not 0 <= end < self.manifest["next_id"]:
                raise NotFound(f"node {end}")
        self.new_edges.setdefault((src, rel, dst), {})

    def create_nodes(self, label: str | tuple[str, ...], df: DataFrame, ext: str) -> DataFrame:
        """Stage a node for each row, ``ext`` naming the column of external ids and the others being properties.

        Returns the rows with their ``id``.  External ids must be new, not 0 and not repeated, which is checked at the commit.
        """
        numbered, n = self._counted(df)
        base, self.next_id = self.next_id, self.next_id + n
        props = [F.col(f"`{c}`") for c in df.columns if c != ext]
        rows = self._fixed(numbered.select((F.col(NUMBER) + F.lit(base)).alias("id"), F.col(f"`{ext}`").cast("bigint").alias(EXT), *props))
        self.bulk_ext.append(rows.select(EXT))
        self.node_frames.append(((label,) if isinstance(label, str) else tuple(label), rows))
        return rows.withColumnRenamed(EXT, ext)

    def create_edges(self, kind: str, df: DataFrame) -> None:
        """Stage a relationship for each row ``(src, dst, properties...)`` of node ids."""
        self.edge_frames.append((kind, df))

    def add_node_label(self, node: int, label: str) -> None:
        self._change_label(node, label, True)

    def remove_node_label(self, node: int, label: str) -> None:
        self._change_label(node, label, False)

    def _change_label(self, node: int, label: str, add: bool) -> None:
        if not self._live(node):
            raise NotFound(f"node {node}")
        if node in self.new_nodes:
            row = self.new_nodes[node]
            rest = tuple(x for x in row.labels if x != label)
            row.labels = (*rest, label) if add else rest
        else:
            self.label_changes.setdefault(node, []).append((label, add))

    def set_node_property(self, node: int, key: str, value: object) -> None:
        if not self._live(node):
            raise NotFound(f"node {node}")
        if node in self.new_nodes:
            self.new_nodes[node].props[key] = value
        elif (node, key) not in self.removed:  # within a transaction a removal wins
            self.new_sets[node, key] = value

    def remove_node_property(self, node: int, key: str) -> None:
        if not self._live(node):
            raise NotFound(f"node {node}")
        if node in self.new_nodes:
            self.new_nodes[node].props.pop(key, None)
        else:
            self.removed.add((node, key))
            self.new_sets[node, key] = None

    def set_edge_property(self, src: int, rel: str, dst: int, key: str, value: object) -> None:
        if (src, rel, dst) in self.new_edges:
            self.new_edges[src, rel, dst][key] = value
            return
        if self.graph._edge(src, rel, dst) is None:
            raise NotFound(f"edge {src}-[{rel}]->{dst}")
        self.edge_sets += self._frames({"src": T.LongType(), "type": T.StringType(), "dst": T.LongType()}, [((src, rel, dst), {f"set:{key}": value})])

    def remove_edge_property(self, src: int, rel: str, dst: int, key: str) -> None:
        self.set_edge_property(src, rel, dst, key, None)

    def _flush(self) -> None:
        """Turn assignments gathered so far into frames, in their order among the statements."""
        rows = [((node,), {f"set:{key}": value}) for (node, key), value in self.new_sets.items()]
        self.node_sets += self._frames({"id": T.LongType()}, rows)
        self.new_sets = {}

    def _frames(self, fixed: dict[str, T.DataType], rows: Iterable[tuple[tuple, dict]]) -> list[DataFrame]:
        """Rows of fixed columns and properties as one frame for each set of property names and kinds."""
        by: dict[tuple, list[tuple[tuple, dict]]] = {}
        odd = []
        for ids, props in rows:
            kinds = tuple((k, type(v)) for k, v in sorted(props.items()))
            if all(t in PLAIN or t is type(None) for _, t in kinds):
                by.setdefault(kinds, []).append((ids, props))
            else:
                odd.append((ids, props))
        out = []
        for kinds, own in by.items():
            columns = {name: pa.array([ids[i] for ids, _ in own], ARROW[type(kind)]) for i, (name, kind) in enumerate(fixed.items())}
            columns |= {k: pa.array([props[k] for _, props in own], PLAIN[t]) for k, t in kinds if t in PLAIN}
            df = self.spark.createDataFrame(pa.table(columns))
            out.append(df.select("*", *[F.lit(None).alias(k) for k, t in kinds if t not in PLAIN]))
        for ids, props in odd:  # lists and the like
            one = self.spark.createDataFrame([ids], T.StructType([T.StructField(name, kind) for name, kind in fixed.items()]))
            out.append(one.select("*", *[self._storable(V.literal(v)).col.alias(k) for k, v in props.items()]))
        return out

    def tombstone_node(self, node: int) -> None:
        if not self._live(node):
            raise NotFound(f"node {node}")
        self.new_edges = {k: v for k, v in self.new_edges.items() if node not in (k[0], k[2])}
        if self.new_nodes.pop(node, None) is None:
            self.seen[node] = False
            self.dead_nodes.append(self.spark.createDataFrame([(node,)], "id long"))

    def tombstone_edge(self, src: int, rel: str, dst: int) -> None:
        if self.new_edges.pop((src, rel, dst), None) is not None:
            return
        if self.graph._edge(src, rel, dst) is None:
            raise NotFound(f"edge {src}-[{rel}]->{dst}")
        self.dead_edges.append(self.spark.createDataFrame([(src, rel, dst)], "src long, type string, dst long"))

    # -- statements

    def run(self, text: str, params: dict | None = None) -> int:
        """Run a statement that writes; returns what it made, set or deleted.  RETURN after it is ignored."""
        query = parse(text)
        if query.explain:
            raise QuerySyntaxError("EXPLAIN of a statement that writes")
        self._flush()
        planner = Planner(self.graph, params)
        state, count, wrote = State(), 0, False
        planner.used = dict.fromkeys({e.var for e in _variables(query)}, None) | {"*": None}
        made: dict[str, tuple] = {}
        for clause in query.clauses:
            if isinstance(clause, A.Create):
                count += self._create(planner, state, clause, made)
            elif isinstance(clause, A.SetProps):
                count += self._set(planner, state, clause)
            elif isinstance(clause, A.Delete):
                count += self._delete(planner, state, clause)
            elif isinstance(clause, A.Projection):
                continue
            else:
                state = planner.clause(state, clause)
                continue
            wrote = True
        if not wrote:
            raise QuerySyntaxError("the statement doesn't write")
        return count

    def _rows(self, state: State) -> DataFrame:
        """The rows a clause works on, fixed once: staged plans must not see other data later."""
        if state.df is None:
            return self.spark.range(1).select()
        names = {c: f"c{i}" for i, c in enumerate(state.df.columns)}
        back = self._fixed(state.df.select(*[ref(c).alias(n) for c, n in names.items()]))
        return back.select(*[F.col(n).alias(c) for c, n in names.items()])

    def _fixed(self, df: DataFrame) -> DataFrame:
        where = f"{self.store.path}/{self.staged}/{uuid.uuid4().hex}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def _counted(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """The rows numbered from 0 in :data:`NUMBER`, by a count for each partition and not in one task, and how many there are."""
        tagged = self._fixed(rows.withColumn("create|p", F.spark_partition_id()).withColumn("create|i", F.monotonically_increasing_id()))
        at, starts = 0, []
        for p, k in sorted((r["create|p"], r["count"]) for r in tagged.groupBy("create|p").count().collect()):
            starts.append((p, at))
            at += k
        table = self.spark.createDataFrame(starts or [(0, 0)], "p int, start long")
        shifted = F.col("create|i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start")
        return tagged.join(F.broadcast(table), F.col("create|p") == F.col("p")).withColumn(NUMBER, shifted).drop("create|p", "create|i", "p", "start"), at

    def _create(self, planner: Planner, state: State, clause: A.Create, made: dict) -> int:
        rows, total, number = self._rows(state), 0, NUMBER
        if rows.columns:
            rows, n = self._counted(rows)
        else:
            rows, n = rows.withColumn(number, F.lit(0).cast("bigint")), 1
        compiler = Compiler(state.scope, planner.params)
        ids: dict[str, object] = {}
        labels_of: dict[str, object] = {}
        for pattern in clause.patterns:
            names = []
            for node in pattern.nodes:
                name = node.var or planner.fresh()
                names.append(name)
                bound = name in ids or name in state.scope.entities
                if bound and (node.labels or node.props or not pattern.rels):
                    raise QuerySyntaxError(f"VariableAlreadyBound ({name})")
                if bound:
                    continue
                base, self.next_id = self.next_id, self.next_id + n
                ext, self.next_ext = self.next_ext, self.next_ext + n
                ids[name], labels_of[name] = F.col(number) + F.lit(base), tuple(dict.fromkeys(node.labels))
                props = self._props(compiler, node.props)
                self.node_frames.append((labels_of[name], rows.select(ids[name].alias("id"), (F.col(number) + F.lit(ext)).alias("_ext"), *props)))
                total += n
            for i, rel in enumerate(pattern.rels):
                if rel.direction == "both":
                    raise QuerySyntaxError("RequiresDirectedRelationship")
                if len(rel.types) != 1:
                    raise QuerySyntaxError("NoSingleRelationshipType")
                if rel.var and rel.var in state.scope.entities:
                    raise QuerySyntaxError(f"VariableAlreadyBound ({rel.var})")
                a, b = (names[i], names[i + 1]) if rel.direction == "out" else (names[i + 1], names[i])
                end = lambda x: ids[x] if x in ids else ref(state.scope.entities[x].column("id"))
                props = self._props(compiler, rel.props)
                self.edge_frames.append((rel.types[0], rows.select(end(a).alias("src"), end(b).alias("dst"), *props)))
                total += n
        return total

    def _props(self, compiler: Compiler, props: tuple) -> list:
        out = []
        for key, expr in props:
            v = self._storable(compiler(expr))
            if v.type.name != "null":
                out.append(v.col.alias(key))
        return out

    def _storable(self, v: Value) -> Value:
        if v.type.name in ("node", "rel", "map") or v.type.name == "list" and (v.type.item or V.NULL).name in ("node", "rel", "map"):
            raise QueryRuntimeError("InvalidPropertyType")
        return Value(V.STRING, V.as_text(v).col) if v.type.name in V.TEMPORAL or v.type.name == "duration" else v

    def _set(self, planner: Planner, state: State, clause: A.SetProps) -> int:
        if state.df is None:
            raise QuerySyntaxError("SET cannot be the first clause")
        rows, compiler, count = self._rows(state), Compiler(state.scope, planner.params), 0
        for name, key, expr in clause.items:
            if name not in state.scope.entities:
                raise QuerySyntaxError(f"UndefinedVariable ({name})")
            e = state.scope.entities[name]
            v = self._storable(compiler(expr))
            parts = ["id"] if e.kind == "node" else ["src", "type", "dst"]
            col = v.col if v.type.name != "null" else F.lit(None)
            staged = rows.filter(ref(e.column(parts[0])).isNotNull()).select(*[ref(e.column(p)).alias(p) for p in parts], col.alias(f"set:{key}"))
            count += staged.count()
            (self.node_sets if e.kind == "node" else self.edge_sets).append(staged)
        return count

    def _delete(self, planner: Planner, state: State, clause: A.Delete) -> int:
        rows, count = self._rows(state), 0
        nodes, edges = [], []
        for expr in clause.exprs:
            if isinstance(expr, A.HasLabels):
                raise QuerySyntaxError("InvalidDelete")
            if not isinstance(expr, A.Var):
                raise QuerySyntaxError("InvalidArgumentType (DELETE)")
            if expr.name not in state.scope.entities:
                raise QuerySyntaxError(f"UndefinedVariable ({expr.name})" if expr.name not in state.scope.values else "InvalidArgumentType (DELETE)")
            e = state.scope.entities[expr.name]
            parts = ["id"] if e.kind == "node" else ["src", "type", "dst"]
            (nodes if e.kind == "node" else edges).append(rows.select(*[ref(e.column(p)).alias(p) for p in parts]).filter(F.col(parts[0]).isNotNull()))
        gone = _union(nodes)
        cut = _union(edges)
        every = Graph(self.spark, self.base, self.base_rels).neighbors().select("src", "type", "dst")
        if gone is not None:
            gone = gone.distinct()
            touched = every.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(every.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")).distinct()
            if not clause.detach:
                left = touched if cut is None else touched.join(cut, ["src", "type", "dst"], "left_anti")
                if not left.isEmpty():
                    raise QueryRuntimeError("DeleteConnectedNode")
            cut = touched if cut is None else cut.unionByName(touched)
            count += gone.count()
            self.dead_nodes.append(gone)
        if cut is not None:
            cut = cut.distinct()
            count += cut.count()
            self.dead_edges.append(cut)
        return count

    # -- commit

    def commit(self) -> int:
        """Validate, write what changed, and publish the new version; returns its number."""
        if not self.open:
            raise StorageError("the transaction is over")
        self._flush()
        sets, dead = _folded(self.node_sets, ["id"]), _union(self.dead_nodes)
        dead = dead.distinct() if dead is not None else None
        moved = self._moved()
        nodes = self._node_entries(sets, dead, moved)
        rels = self._rel_entries(nodes, dead, moved)
        return self._finish(nodes, rels)

    def compact(self) -> int:
        """Write tables of several folders as one."""
        if all(len(e["paths"]) < 2 for e in [*self.manifest["nodes"], *self.manifest["rels"]]):
            return self.manifest["version"]
        each = [[e if len(e["paths"]) < 2 else self._written(e, self.store._frame(e), f"{kind}-{i}") for i, e in enumerate(self.manifest[kind])] for kind in ("nodes", "rels")]
        return self._finish(*each)

    def _finish(self, nodes: list[dict], rels: list[dict]) -> int:
        m = self.manifest
        top = max(self.new_ext, default=0)
        for df in self.bulk_ext:
            top = max(top, df.agg(F.max(EXT)).collect()[0][0] or 0)
        new = {"format": FORMAT, "version": m["version"] + 1, "next_id": self.next_id, "next_ext": max(self.next_ext, top + 1), "nodes": nodes, "rels": rels}
        new["labels"] = list(dict.fromkeys([*m["labels"], *[x for e in nodes for x in e["labels"]]]))
        new["types"] = list(dict.fromkeys([*m["types"], *[e["type"] for e in rels]]))
        self._owned()
        self.store._publish(new)
        self.kept = True
        self.rollback()
        return new["version"]

    def _written(self, entry: dict, df: DataFrame, name: str, before: dict | None = None) -> dict:
        """``entry`` with ``df`` as its table, or as one more folder of the table ``before``."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(f"{self.store.path}/{path}")
        fields = {f.name: f for f in (T.StructType.fromJson(before["schema"]).fields if before else [])} | {f.name: f for f in df.schema.fields}
        out = entry | {"paths": [*(before["paths"] if before else []), path], "schema": json.loads(T.StructType(list(fields.values())).json())}
        if "id" in df.columns:
            lo, hi = self.spark.read.schema(df.schema).parquet(f"{self.store.path}/{path}").agg(F.min("id"), F.max("id")).collect()[0]
            spans = [x for x in ((lo, hi), tuple((before or {}).get("ids") or (None, None))) if x[0] is not None]
            out["ids"] = [min(x[0] for x in spans), max(x[1] for x in spans)] if spans else [0, -1]
        return out

    def _fits(self, entry: dict, df: DataFrame) -> bool:
        """Whether the rows can stand in a folder of their own: no property has another kind than before."""
        old = {f.name: f.dataType for f in T.StructType.fromJson(entry["schema"]).fields}
        return len(entry["paths"]) < MAX_PARTS and all(old.get(f.name, f.dataType) == f.dataType for f in df.schema.fields)

    def _moved(self) -> dict[int, tuple[tuple[str, ...], tuple[str, ...]]]:
        """The label sets before and after of nodes whose labels change."""
        if not self.label_changes:
            return {}
        ids = self.spark.createDataFrame([(i,) for i in self.label_changes], "id long")
        out = {}
        for t in self.base:
            for r in t.df.select("id").join(F.broadcast(ids), "id").collect():  # as many as there are typed calls
                new = list(t.labels)
                for label, add in self.label_changes[r["id"]]:
                    new = [x for x in new if x != label] + [label] * add
                if tuple(new) != t.labels:
                    out[r["id"]] = (t.labels, tuple(new))
        return out

    def _node_entries(self, sets: DataFrame | None, dead: DataFrame | None, moved: dict) -> list[dict]:
        old = {tuple(e["labels"]): e for e in self.manifest["nodes"]}
        new: dict[tuple[str, ...], list[DataFrame]] = {}
        for labels, df in self.node_frames:
            new.setdefault(labels, []).append(df)
        typed: dict[tuple[str, ...], list] = {}
        for row in self.new_nodes.values():
            typed.setdefault(row.labels, []).append(((row.id, row.ext), {k: v for k, v in row.props.items() if v is not None}))
        for labels, rows in typed.items():
            new.setdefault(labels, []).extend(self._frames({"id": T.LongType(), EXT: T.LongType()}, rows))
        self._check_ext()
        changed = [df.select("id") for df in (sets, dead) if df is not None]
        if moved:
            gone = self.spark.createDataFrame([(i,) for i in moved], "id long")
            changed.append(gone)
        changed = _union(changed)
        touched = {labels for labels, e in old.items() if changed is not None and _meets(self.store._frame(e), changed, "id")}

        def current(labels: tuple[str, ...]) -> DataFrame:
            df = self.store._frame(old[labels])
            df = df if dead is None else df.join(dead, "id", "left_anti")
            return df if sets is None else _applied(df, sets, ["id"])

        for before, after in set(moved.values()):
            ids = [i for i, pair in moved.items() if pair == (before, after)]
            new.setdefault(after, []).append(current(before).join(F.broadcast(self.spark.createDataFrame([(i,) for i in ids], "id long")), "id", "left_semi"))
        out = []
        for i, labels in enumerate(dict.fromkeys([*old, *new])):
            entry, frames = {"labels": list(labels)}, new.get(labels, [])
            rows = _widened(frames) if frames else None
            if labels in old and labels not in touched:
                if rows is None:
                    out.append(old[labels])
                    continue
                if self._fits(old[labels], rows):
                    out.append(self._written(entry, rows, f"nodes-{i}", old[labels]))
                    continue
            if labels in old:
                base = current(labels) if labels in touched else self.store._frame(old[labels])
                if moved:
                    base = base.join(F.broadcast(gone), "id", "left_anti")
                rows = _widened([base, *frames])
            out.append(self._written(entry, rows, f"nodes-{i}"))
        return out

    def _check_ext(self) -> None:
        """External ids of whole frames: none is 0 or null, repeated, or taken."""
        if not self.bulk_ext:
            return
        every = _union(self.bulk_ext)
        if self.new_ext:
            every = every.unionByName(self.spark.createDataFrame([(x,) for x in self.new_ext], f"{EXT} long"))
        bad = every.filter(f"{EXT} is null or {EXT} = 0").unionByName(every.groupBy(EXT).count().filter("count > 1").select(EXT))
        low = every.filter(F.col(EXT) < self.manifest["next_ext"])  # larger ones are new
        bad = bad.unionByName(low.join(self.graph.external_ids().select(F.col("ext").alias(EXT)), EXT, "left_semi"))
        found = bad.take(1)
        if found:
            raise Duplicate(f"external id {found[0][0]}")

    def _new_rels(self, frames: dict[str, list[DataFrame]], nodes: list[dict]) -> dict[tuple, DataFrame]:
        """Staged relationships by type and the label sets of their ends, each pair once; both ends must be live nodes."""
        out = {}
        for kind, own in frames.items():
            df = _widened([x.withColumn("_order", F.lit(i)) for i, x in enumerate(own)])
            props = [c for c in df.columns if c not in ("src", "dst", "_order")]
            # made twice, it is one relationship with the properties given last
            once = df.groupBy("src", "dst").agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_order"))).alias(c) for c in props]) if props else df.select("src", "dst").distinct()
            once = self._fixed(once)
            ids = once.select(F.col("src").alias("id")).unionByName(once.select(F.col("dst").alias("id"))).distinct()
            few = once.count() <= FEW
            live = [self.store._frame(e).select("id", F.lit("\x1f".join(e["labels"])).alias("labels")) for e in nodes]
            live = reduce(DataFrame.unionAll, live) if live else self.spark.createDataFrame([], "id long, labels string")
            found = self._fixed(live.join(F.broadcast(ids) if few else ids, "id", "left_semi"))
            ends = once
            for end, name in (("src", "_s"), ("dst", "_t")):
                ends = ends.join(found.select(F.col("id").alias(end), F.col("labels").alias(name)), end, "left")
            ends = self._fixed(ends)
            if not ends.filter("_s is null or _t is null").isEmpty():
                raise NotFound(f"an end of a {kind} relationship")
            for r in ends.select("_s", "_t").distinct().collect():  # as many as there are pairs of label sets
                part = ends.filter((F.col("_s") == r["_s"]) & (F.col("_t") == r["_t"])).select(*[F.col(f"`{c}`") for c in once.columns])
                out[kind, tuple(_labels(r["_s"])), tuple(_labels(r["_t"]))] = part
        return out

    def _rel_entries(self, nodes: list[dict], dead: DataFrame | None, moved: dict) -> list[dict]:
        old = {(e["type"], tuple(e["source"]), tuple(e["target"])): e for e in self.manifest["rels"]}
        frames: dict[str, list[DataFrame]] = {}
        for kind, df in self.edge_frames:
            frames.setdefault(kind, []).append(df)
        typed: dict[str, list] = {}
        for (src, kind, dst), props in self.new_edges.items():
            typed.setdefault(kind, []).append(((src, dst), {k: v for k, v in props.items() if v is not None}))
        for kind, rows in typed.items():
            frames.setdefault(kind, []).extend(self._frames({"src": T.LongType(), "dst": T.LongType()}, rows))
        sets, cut = _folded(self.edge_sets, ["src", "type", "dst"]), _union(self.dead_edges)
        kinds = {r["type"] for df in (sets, cut) if df is not None for r in df.select("type").distinct().collect()}
        gone = _union([df for df in (dead, self.spark.createDataFrame([(i,) for i in moved], "id long") if moved else None) if df is not None])
        current: dict[tuple, DataFrame] = {}
        for key, e in old.items():
            df, touched = self.store._frame(e), False
            if key[0] in kinds:
                touched = True
                if sets is not None:
                    df = _applied(df, sets.filter(F.col("type") == key[0]).drop("type"), ["src", "dst"])
                if cut is not None:
                    df = df.join(cut.filter(F.col("type") == key[0]).select("src", "dst"), ["src", "dst"], "left_anti")
            if gone is not None and (_meets(df, gone, "src") or _meets(df, gone, "dst")):
                touched = True
                for end in ("src", "dst"):
                    df = df if dead is None else df.join(dead.withColumnRenamed("id", end), end, "left_anti")
                if moved:  # their ends have other labels now: to be placed like new ones, before what is new
                    some = F.broadcast(self.spark.createDataFrame([(i,) for i in moved], "id long"))
                    at = df.join(some.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(df.join(some.withColumnRenamed("id", "dst"), "dst", "left_semi"))
                    frames.setdefault(key[0], []).insert(0, self._fixed(at.dropDuplicates(["src", "dst"])))
                    for end in ("src", "dst"):
                        df = df.join(some.withColumnRenamed("id", end), end, "left_anti")
            if touched:
                current[key] = df
        new, out = self._new_rels(frames, nodes), []
        for i, key in enumerate(dict.fromkeys([*old, *new])):
            entry = {"type": key[0], "source": list(key[1]), "target": list(key[2])}
            rows, e = new.get(key), old.get(key)
            if e and rows is not None:
                there = current[key] if key in current else self.store._frame(e)
                both = there.select("src", "dst")
                if rows.columns == ["src", "dst"]:
                    rows = rows.join(both, ["src", "dst"], "left_anti")
                elif not rows.join(both, ["src", "dst"], "left_semi").isEmpty():
                    # an edge that is made again is the same edge: it takes the new properties that are given
                    every = _widened([there.withColumn("_order", F.lit(0)), rows.withColumn("_order", F.lit(1))])
                    props = [c for c in every.columns if c not in ("src", "dst", "_order")]
                    current[key] = every.groupBy("src", "dst").agg(*[F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col("_order"))).alias(c) for c in props])
                    rows = None
            if e and key not in current:
                if rows is None:
                    out.append(e)
                    continue
                if self._fits(e, rows):
                    out.append(self._written(entry, rows, f"rels-{i}", e))
                    continue
                current[key] = self.store._frame(e)
            if e:
                rows = current[key] if rows is None else _widened([current[key], rows])
            out.append(self._written(entry, rows, f"rels-{i}"))
        return out


def _meets(df: DataFrame, ids: DataFrame, column: str) -> bool:
    """Whether one of ``ids`` stands in a column."""
    return not df.select(F.col(column).alias("id")).join(ids, "id", "left_semi").isEmpty()


def _labels(text: str) -> list[str]:
    return [x for x in text.split("\x1f") if x]


def _variables(query: A.Query):
    from ..plans.planner import walk

    return [e for e in walk(query.clauses) if isinstance(e, (A.NodePattern, A.RelPattern)) and e.var]


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


FIXED = ("id", EXT, "src", "dst", "_order")


def _widened(frames: list[DataFrame]) -> DataFrame:
    """The rows of tables whose properties may differ; kinds that differ meet as text."""
    kinds: dict[str, V.Type] = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name not in FIXED:
                kind = V.from_spark(f.dataType)
                kinds[f.name] = kind if f.name not in kinds else (V.common([kinds[f.name], kind]) or V.STRING)
    parts = []
    for df in frames:
        fixed = [c for c in FIXED if c in df.columns]
        cols = [V.widened(V.column_value(F.col(f"`{k}`"), df.schema[k].dataType), t).alias(k) if k in df.columns else F.lit(None).cast(V.spark_type(t)).alias(k) for k, t in kinds.items()]
        parts.append(df.select(*fixed, *cols))
    return _union(parts)


def _folded(sets: list[DataFrame], keys: list[str]) -> DataFrame | None:
    """One row for each entity: of each key the last assignment, with a mark where there was one; ``unset:`` where all are null."""
    if not sets:
        return None
    names = list(dict.fromkeys(c for df in sets for c in df.columns if c not in keys))
    kinds = {}
    for df in sets:
        for c in df.columns:
            if c not in keys:
                kind = V.from_spark(df.schema[c].dataType)
                kinds[c] = kind if c not in kinds else (V.common([kinds[c], kind]) or V.STRING)
    unset = {c for c, k in kinds.items() if k.name == "null"}
    kinds |= dict.fromkeys(unset, V.BOOL)
    parts = []
    for i, df in enumerate(sets):
        cols = []
        for c in names:
            if c in df.columns:
                value = V.widened(V.column_value(F.col(f"`{c}`"), df.schema[c].dataType), kinds[c])
                cols.append(F.struct(F.lit(i).alias("at"), value.alias("v")).alias(c))
            else:
                cols.append(F.lit(None).cast(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("v", V.spark_type(kinds[c]))])).alias(c))
        parts.append(df.select(*keys, *cols))
    return _union(parts).groupBy(*keys).agg(*[F.max(F.col(f"`{c}`")).alias(c.replace("set:", "unset:", 1) if c in unset else c) for c in names])


def _applied(df: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in sets.columns if c.startswith("set:")]
    joined = df.join(sets, keys, "left")
    cols = []
    for c in [*df.columns, *[n[4:] for n in names if n[4:] not in df.columns]]:
        if f"unset:{c}" in sets.columns:
            cols.append(F.when(F.col(f"`unset:{c}`").isNull(), F.col(f"`{c}`")).alias(c))
            continue
        if f"set:{c}" not in names:
            cols.append(F.col(f"`{c}`"))
            continue
        mark = F.col(f"`set:{c}`")
        kind = V.from_spark(sets.schema[f"set:{c}"].dataType.fields[1].dataType)
        if c not in df.columns:
            cols.append(mark["v"].alias(c))
            continue
        old = V.column_value(F.col(f"`{c}`"), df.schema[c].dataType)
        wide = V.common([old.type, kind]) or V.STRING
        cols.append(F.when(mark.isNotNull(), V.widened(Value(kind, mark["v"]), wide)).otherwise(V.widened(old, wide)).alias(c))
    return joined.select(*cols)


__all__ = ["Scope", "Store", "Transaction", "scratch_store"]
