"""A property graph as node and relationship tables.

A *node table* holds the nodes of one set of labels, a *relationship table* those of one type between
two sets of labels; properties are columns.  A node's id is ``ordinal << 48 | key``, the ordinal
being its table's place, so that ids of different tables never meet and a table's order is
that of its keys.  A relationship is identified by source, type and target.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound
from ..operators import values as V
from ..operators.values import Type

KEY_BITS = 48
EXT = "_ext"


@dataclass(frozen=True)
class NodeTable:
    """``df`` has ``id`` (long) and the property columns; ``ext`` names the column that is the external id, if any.

    :data:`EXT` is an external id that is no property.  ``ids``: the smallest and largest id, where they are known.
    """

    labels: tuple[str, ...]
    df: DataFrame
    ext: str | None = None
    ids: tuple[int, int] | None = None

    def props(self) -> dict[str, Type]:
        return {f.name: V.from_spark(f.dataType) for f in self.df.schema.fields if f.name not in ("id", EXT)}

    def may_hold(self, node: int) -> bool:
        return self.ids is None or self.ids[0] <= node <= self.ids[1]


@dataclass(frozen=True)
class RelTable:
    """``df`` has ``src`` and ``dst`` (long) and the property columns.

    ``single``: the ends at which a node has one relationship at most, where that is known.  ``pairs``: where ``df`` has one row
    for all that have the same ends, the ends of these.
    """

    type: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    df: DataFrame
    single: tuple[str, ...] = ()
    pairs: DataFrame | None = None

    def props(self) -> dict[str, Type]:
        return {f.name: V.from_spark(f.dataType) for f in self.df.schema.fields if f.name not in ("src", "dst")}


def merged_props(tables: list) -> dict[str, Type]:
    """The properties of several tables; kinds that differ meet as text."""
    out: dict[str, Type] = {}
    for t in tables:
        for k, kind in t.props().items():
            out[k] = kind if k not in out else (V.common([out[k], kind]) or V.STRING)
    return out


def _place(names: list[str], name: str) -> int | None:
    return names.index(name) if name in names else None


def _at(names: list[str], number: int) -> str | None:
    return names[number] if 0 <= number < len(names) else None


def _total(tables: list[DataFrame]) -> int:
    """The rows of all tables, counted in one job."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")) for t in tables]
    return reduce(DataFrame.unionAll, counts).agg(F.sum("n")).collect()[0][0] if counts else 0


@dataclass
class Graph:
    """An immutable graph; reading methods return DataFrames."""

    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    #: Labels and types in the order of their numbers, where a store has numbered them.
    numbered: tuple[tuple[str, ...], tuple[str, ...]] | None = None

    # -- building

    def add_nodes(self, labels: str | tuple[str, ...], df: DataFrame, key: str, props: list[str] | None = None) -> Graph:
        """A table of nodes whose whole-number column ``key`` is unique and from 0 to 2**48 - 1."""
        labels = (labels,) if isinstance(labels, str) else tuple(labels)
        base = len(self.nodes) << KEY_BITS
        keep = [c for c in (props if props is not None else df.columns)]
        rows = df.select((F.col(key).cast("bigint") + F.lit(base)).alias("id"), *keep)
        return Graph(self.spark, [*self.nodes, NodeTable(labels, rows, key, (base, base + (1 << KEY_BITS) - 1))], self.rels)

    def base(self, label: str) -> int:
        for i, t in enumerate(self.nodes):
            if label in t.labels:
                return i << KEY_BITS
        raise NotFound(f"no nodes are labelled {label}")

    def add_rels(self, kind: str, df: DataFrame, source: tuple[str, str], target: tuple[str, str], props: dict[str, Column] | None = None, unique: bool = True, single: tuple[str, ...] = ()) -> Graph:
        """Relationships from the key columns of ``df``; ``source`` and ``target`` are ``(label, column)``.

        ``unique``: the pairs are distinct already.  Otherwise equal pairs become one relationship, and
        ``props`` are aggregates over them.  Rows with a null key have no relationship.  ``single``: as :class:`RelTable` has it.
        """
        ends = [(F.col(c).cast("bigint") + F.lit(self.base(label))).alias(name) for name, (label, c) in (("src", source), ("dst", target))]
        named = [c.alias(k) for k, c in (props or {}).items()]
        present = df.filter(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull())
        if unique:
            rows = present.select(*ends, *named)
        elif named:
            rows = present.groupBy(*ends).agg(*named)
        else:
            rows = present.select(*ends).distinct()
        of = lambda label: next(t.labels for t in self.nodes if label in t.labels)
        return Graph(self.spark, self.nodes, [*self.rels, RelTable(kind, of(source[0]), of(target[0]), rows, single, None if unique else present.select(*ends))])

    # -- reading

    def node_tables(self, labels: tuple[str, ...] = ()) -> list[NodeTable]:
        return [t for t in self.nodes if set(labels) <= set(t.labels)]

    def rel_tables(self, types: tuple[str, ...] = ()) -> list[RelTable]:
        return [t for t in self.rels if not types or t.type in types]

    def labels(self) -> list[str]:
        return sorted({x for t in self.nodes for x in t.labels})

    def types(self) -> list[str]:
        return sorted({t.type for t in self.rels})

    def label_names(self) -> list[str]:
        """Labels by number."""
        return list(self.numbered[0]) if self.numbered else list(dict.fromkeys(x for t in self.nodes for x in t.labels))

    def type_names(self) -> list[str]:
        return list(self.numbered[1]) if self.numbered else list(dict.fromkeys(t.type for t in self.rels))

    def label_id(self, name: str) -> int | None:
        return _place(self.label_names(), name)

    def label_name(self, number: int) -> str | None:
        return _at(self.label_names(), number)

    def type_id(self, name: str) -> int | None:
        return _place(self.type_names(), name)

    def type_name(self, number: int) -> str | None:
        return _at(self.type_names(), number)

    def scan_nodes(self, tables: list[NodeTable], props: dict[str, Type] | None = None) -> DataFrame:
        """``id``, ``labels`` and properties of the given tables, in one schema."""
        props = merged_props(tables) if props is None else props
        out = None
        for t in tables:
            own = t.props()
            cols = [V.widened(V.column_value(F.col(f"`{k}`"), t.df.schema[k].dataType), kind).alias(k) if k in own else F.lit(None).cast(V.spark_type(kind)).alias(k) for k, kind in props.items()]
            rows = t.df.select("id", F.array(*map(F.lit, t.labels)).cast("array<string>").alias("labels"), *cols)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), *[T.StructField(k, V.spark_type(kind)) for k, kind in props.items()]])
            out = self.spark.createDataFrame([], schema)
        return out

    def scan_rels(self, tables: list[RelTable], props: dict[str, Type] | None = None) -> DataFrame:
        """``src``, ``type``, ``dst`` and properties of the given tables."""
        props = merged_props(tables) if props is None else props
        out = None
        for t in tables:
            own = t.props()
            cols = [V.widened(V.column_value(F.col(f"`{k}`"), t.df.schema[k].dataType), kind).alias(k) if k in own else F.lit(None).cast(V.spark_type(kind)).alias(k) for k, kind in props.items()]
            rows = t.df.select("src", F.lit(t.type).alias("type"), "dst", *cols)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], T.StructType([T.StructField("src", T.LongType()), T.StructField("type", T.StringType()), T.StructField("dst", T.LongType()), *[T.StructField(k, V.spark_type(kind)) for k, kind in props.items()]]))
        return out

    # -- the typed interface

    def all_nodes(self) -> DataFrame:
        return self.scan_nodes(self.nodes)

    def nodes_with_label(self, label: str) -> DataFrame:
        return self.scan_nodes(self.node_tables((label,)))

    def nodes_with_label_and_property(self, label: str, key: str, value: object) -> DataFrame:
        tables = [t for t in self.node_tables((label,)) if key in t.props()]
        found = self.scan_nodes(tables)
        if not tables or value is None:
            return found.filter(F.lit(False))
        kind = merged_props(tables)[key]
        return found.filter(F.coalesce(V.equal(Value(kind, F.col(f"`{key}`")), V.literal(value)).col, F.lit(False)))

    def neighbors(self, node: int | None = None, rel: str | None = None) -> DataFrame:
        """Outgoing relationships of a node, or of all."""
        found = self.scan_rels(self.rel_tables((rel,) if rel else ()))
        return found if node is None else found.filter(F.col("src") == node)

    def incoming_neighbors(self, node: int | None = None, rel: str | None = None) -> DataFrame:
        found = self.scan_rels(self.rel_tables((rel,) if rel else ()))
        return found if node is None else found.filter(F.col("dst") == node)

    def node_property(self, node: int, key: str) -> object:
        row = self._node(node)
        return row[key] if row is not None and key in row.__fields__ else None

    def edge_property(self, src: int, rel: str, dst: int, key: str) -> object:
        row = self._edge(src, rel, dst)
        return row[key] if row is not None and key in row.__fields__ else None

    def node_properties(self, node: int) -> dict:
        row = self._node(node)
        return {} if row is None else {k: v for k, v in row.asDict(True).items() if v is not None and k not in ("id", "labels")}

    def edge_properties(self, src: int, rel: str, dst: int) -> dict:
        row = self._edge(src, rel, dst)
        return {} if row is None else {k: v for k, v in row.asDict(True).items() if v is not None and k not in ("src", "type", "dst")}

    def _node(self, node: int):
        rows = self.scan_nodes([t for t in self.nodes if t.may_hold(node)]).filter(F.col("id") == node).take(1)
        return rows[0] if rows else None

    def _edge(self, src: int, rel: str, dst: int):
        rows = self.neighbors(src, rel).filter(F.col("dst") == dst).take(1)
        return rows[0] if rows else None

    def is_tombstoned(self, node: int) -> bool:
        return self._node(node) is None

    def node_labels(self, node: int) -> list[str]:
        row = self._node(node)
        return [] if row is None else list(row["labels"])

    def node_label(self, node: int) -> str | None:
        """The first of a node's labels."""
        return next(iter(self.node_labels(node)), None)

    def external_ids(self, label: str | None = None) -> DataFrame:
        """``(id, ext, labels)`` of all nodes that have an external id, or of those with a label."""
        out = self.spark.createDataFrame([], "id long, ext long, labels array<string>")
        for t in self.node_tables((label,) if label else ()):
            if t.ext:
                names = F.array(*map(F.lit, t.labels)).cast("array<string>")
                out = out.unionByName(t.df.select("id", F.col(f"`{t.ext}`").cast("bigint").alias("ext"), names.alias("labels")))
        return out

    def lookup_internal_id(self, ext: int, label: str | None = None) -> int | None:
        """The id of the node with an external id; of the smallest, where labels have external ids of their own."""
        return self.external_ids(label).filter(F.col("ext") == ext).agg(F.min("id")).collect()[0][0]

    def resolve_external(self, node: int) -> int | None:
        some = Graph(self.spark, [t for t in self.nodes if t.may_hold(node)])
        return some.external_ids().filter(F.col("id") == node).agg(F.min("ext")).collect()[0][0]

    def node_count(self, label: str | None = None) -> int:
        return _total([t.df for t in self.node_tables((label,) if label else ())])

    def edge_count(self, rel: str | None = None) -> int:
        return _total([t.df for t in self.rel_tables((rel,) if rel else ())])

    def out_degree(self, rel: str | None = None) -> DataFrame:
        return self.neighbors(rel=rel).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    def in_degree(self, rel: str | None = None) -> DataFrame:
        return self.incoming_neighbors(rel=rel).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


Value = V.Value
