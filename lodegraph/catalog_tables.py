"""The graph over the star-schema and text tables of a directory."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources.catalog import Graph


def star_graph(spark: SparkSession, folder: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users and events, and the relationships of their keys.

    Items of an order are its relationships to parts and suppliers: equal pairs are one
    relationship, with their summed quantity.
    """
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    region, nation, customer, supplier, part, orders, lineitem, events = map(read, ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))
    g = Graph(spark)
    for label, df, key in (("Region", region, "r_regionkey"), ("Nation", nation, "n_nationkey"), ("Customer", customer, "c_custkey"), ("Supplier", supplier, "s_suppkey"), ("Part", part, "p_partkey"), ("Order", orders, "o_orderkey")):
        g = g.add_nodes(label, df, key)
    g = g.add_nodes("User", events.select("user_id").distinct(), "user_id")
    g = g.add_nodes("Event", events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "event_id")
    g = g.add_rels("IN_REGION", nation, ("Nation", "n_nationkey"), ("Region", "n_regionkey"), single=("src",))
    g = g.add_rels("FROM_NATION", customer, ("Customer", "c_custkey"), ("Nation", "c_nationkey"), single=("src",))
    g = g.add_rels("FROM_NATION", supplier, ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), single=("src",))
    g = g.add_rels("PLACED", orders, ("Customer", "o_custkey"), ("Order", "o_orderkey"), {"date": F.date_format("o_orderdate", "yyyy-MM-dd")}, single=("dst",))
    g = g.add_rels("EMITTED", events, ("User", "user_id"), ("Event", "event_id"), single=("dst",))
    quantity = {"qty": F.sum(F.col("l_quantity").cast("double"))}
    g = g.add_rels("CONTAINS", lineitem, ("Order", "l_orderkey"), ("Part", "l_partkey"), quantity, unique=False)
    return g.add_rels("SUPPLIED_BY", lineitem, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), unique=False)


@lru_cache(maxsize=4)
def opened(spark: SparkSession, folder: str) -> Graph:
    """:func:`star_graph`, listed and typed once for a session; for tables that no one rewrites meanwhile."""
    return star_graph(spark, folder)


def text_graph(spark: SparkSession, folder: str) -> Graph:
    """Documents, pages and the turns of conversations, each turn with a relationship to the next."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    key = (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("key")
    turns = read("conversations").select("*", key)
    g = Graph(spark).add_nodes("Document", read("documents"), "doc_id").add_nodes("Page", read("pages"), "page_id")
    g = g.add_nodes("Turn", turns, "key", ["conv_id", "turn", "role", "text"])
    there = read("conversations").select(key)
    steps = turns.select("key", (F.col("key") + 1).alias("next")).join(there.select(F.col("key").alias("next")), "next", "left_semi")
    return g.add_rels("NEXT", steps, ("Turn", "key"), ("Turn", "next"), single=("src", "dst"))


def ring_graph(spark: SparkSession, nodes: int, degree: int) -> Graph:
    """The benchmark's ring: node ``i`` has relationships to the ``degree`` nodes after it."""
    i = F.col("id")
    rows = spark.range(nodes).select((i + 1).alias("ext"), F.concat(F.lit("node_"), i.cast("string")).alias("name"), F.concat(F.lit("kind_"), (i % 8).cast("string")).alias("kind"), F.lit("active").alias("status"), (i % 64).alias("chapter"), i.alias("key"))
    g = Graph(spark).add_nodes("Item", rows, "key", ["ext", "name", "kind", "status", "chapter"])
    ends = spark.range(nodes).select(i.alias("s"), F.explode(F.sequence(F.lit(1), F.lit(degree))).alias("j")).select("s", ((F.col("s") + F.col("j")) % nodes).alias("d"))
    return g.add_rels("NEXT", ends, ("Item", "s"), ("Item", "d"))
