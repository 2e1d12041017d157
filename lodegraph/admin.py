"""Integrity checks of a stored graph, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GraphError
from .sources.catalog import Graph
from .sources.store import Store

SCHEMA = "kind string, detail string, n long"
#: Rows that a task of the checks sorts or groups, about.
ROWS = 1 << 20


def check_graph(g: Graph) -> DataFrame:
    """``(kind, detail, n)`` for every sort of damage found; no rows for a sound graph.

    Rows are counted first, and dealt out by their ids to as many tasks as they need.  Relationships that are made of equal
    pairs can't stand there twice; their ends are looked up before that, so that only orphans are made one.
    """
    found: list[DataFrame] = []

    def report(kind: str, detail: str, bad: DataFrame) -> None:
        found.append(bad.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), "n"))

    ids = None
    for t in g.nodes:
        name = ":".join(t.labels) or "(no label)"
        report("NullNodeId", name, t.df.filter("id is null"))
        if "_ext" in t.df.columns:
            report("ReservedExternalId", name, t.df.filter("_ext = 0 or _ext is null"))
        own = t.df.select("id", *(["_ext"] if "_ext" in t.df.columns else []))
        ids = own if ids is None else ids.unionByName(own, allowMissingColumns=True)
    if ids is None:
        ids = g.spark.createDataFrame([], "id long")
    ends = [t.df.select("src", "dst") if t.pairs is None else t.pairs for t in g.rels]
    counts = [df.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n")) for i, df in enumerate((ids, *ends))]
    first, *others = [r["n"] for r in sorted(reduce(DataFrame.unionAll, counts).collect())]
    tasks = -(-(first + max(others, default=0)) // ROWS)

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(tasks, *keys) if tasks > 1 else df

    def known(end: str) -> DataFrame:
        own = dealt(ids.select("id"), "id").withColumnRenamed("id", end)
        return own.hint("merge") if tasks > 1 else own

    report("DuplicateNodeId", "", dealt(ids.select("id"), "id").groupBy("id").count().filter("count > 1"))
    if "_ext" in ids.columns:
        report("DuplicateExternalId", "", dealt(ids.select("_ext").filter("_ext is not null"), "_ext").groupBy("_ext").count().filter("count > 1"))
    for t, pairs in zip(g.rels, ends, strict=True):
        report("NullEdgeEnd", t.type, pairs.filter("src is null or dst is null"))
        if t.pairs is None:
            report("DuplicateEdge", t.type, dealt(pairs, "src", "dst").groupBy("src", "dst").count().filter("count > 1"))
        for end in ("src", "dst"):
            orphans = dealt(pairs.filter(f"{end} is not null"), end).join(known(end), end, "left_anti")
            report("OrphanEdge", f"{t.type}.{end}", orphans if t.pairs is None else orphans.distinct())
    return reduce(DataFrame.unionAll, found)


def repair_store(spark: SparkSession, path: str) -> int:
    """Publish a version without damaged rows, if there are any; returns the current version.

    Nodes without an id or with one that another has, and relationships without an end, with an end that is no node, or
    that stand there twice, go; tables without such rows are carried over.  Which of two equal ids stays is not defined.
    """
    store = Store(spark, path)
    with store.begin() as t:
        bad = {(r["kind"], r["detail"].rpartition(".")[0] or r["detail"]) for r in check_graph(t.graph).collect()}
        if not {k for k, _ in bad} & {"NullNodeId", "DuplicateNodeId", "NullEdgeEnd", "DuplicateEdge", "OrphanEdge"}:
            return t.manifest["version"]
        m, nodes, rels, ids = t.manifest, [], [], None
        for i, e in enumerate(m["nodes"]):
            df = store._frame(e)
            if {k for k, _ in bad} & {"NullNodeId", "DuplicateNodeId"}:
                df = df.filter("id is not null").dropDuplicates(["id"])
                df = df if ids is None else df.join(ids, "id", "left_anti")
                e = t._written(e, df, f"nodes-{i}")
            nodes.append(e)
            own = store._frame(e).select("id")
            ids = own if ids is None else ids.unionAll(own)
        for i, e in enumerate(m["rels"]):
            if any(d == e["type"] for _, d in bad) and ids is not None:
                df = store._frame(e).dropDuplicates(["src", "dst"])
                for end in ("src", "dst"):
                    df = df.join(ids.select(F.col("id").alias(end)), end, "left_semi")
                e = t._written(e, df, f"rels-{i}")
            rels.append(e)
        return t._finish(nodes, rels)


def check_store(spark: SparkSession, path: str) -> DataFrame:
    """Checks of a stored graph; a manifest or table that can't be read is damage too."""
    try:
        store = Store(spark, path)
        m = store.manifest()
        return check_graph(store._graph(m))
    except GraphError as e:
        return spark.createDataFrame([("UnreadableStore", str(e), 1)], SCHEMA)
    except Exception as e:  # Spark's own errors for missing tables
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([("MissingTable", str(e).splitlines()[0], 1)], SCHEMA)
