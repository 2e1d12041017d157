"""Times of the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodegraph.catalog_tables import ring_graph
from lodegraph.queries import QUERIES
from lodegraph.session import Session
from lodegraph.sources.store import Store, scratch_store

SF, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NODES, DEGREE = 100_000, 5
NAMES = ("hop2", "hop3", "hop4", "type_union", "shared_node", "collapsed_edge", "edge_unique", "quant_any", "temporal_truncate", "api_out_degree", "api_node_count", "x_group", "x_optional")


def timed(run, times: int = 3) -> float:
    """The best of a few runs after one to warm up."""
    run()
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - began)
    return round(best, 4)


def drained(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='lodegraph-bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {name: timed(lambda n=name: drained(QUERIES[n](spark, SF))) for name in NAMES}

    ring = ring_graph(spark, NODES, DEGREE)
    stores: list[Store] = []

    def load() -> None:
        """Nodes, relationships and commit through the store's typed interface."""
        store = scratch_store(spark)
        with store.begin() as t:
            nodes = t.create_nodes("Item", ring.nodes[0].df.drop("id"), "ext").select("id", (F.col("ext") - 1).alias("key"))
            ends = ring.rels[0].df.join(nodes.withColumnsRenamed({"id": "s", "key": "src"}), "src").join(nodes.withColumnsRenamed({"id": "d", "key": "dst"}), "dst")
            t.create_edges("NEXT", ends.select(F.col("s").alias("src"), F.col("d").alias("dst")))
            t.commit()
        stores.append(store)

    def load_by_calls() -> None:
        """The same, one call for each node, property and relationship."""
        store = scratch_store(spark)
        with store.begin() as t:
            ids = [t.create_node(k + 1, "Item") for k in range(NODES)]
            for k, node in enumerate(ids):
                for key, value in (("name", f"node_{k}"), ("kind", f"kind_{k % 8}"), ("status", "active"), ("chapter", k % 64)):
                    t.set_node_property(node, key, value)
                for j in range(1, DEGREE + 1):
                    t.create_edge(node, "NEXT", ids[(k + j) % NODES])
            t.commit()

    found["ring_load"] = timed(load, 2)
    found["ring_load_by_calls"] = timed(load_by_calls, 1)
    g = stores[-1].graph()
    s = Session(g, extended=True)

    def small_commit() -> None:
        with stores[-1].begin() as t:
            nodes = [t.create_node(NODES + 10 + t.next_id, "Extra") for _ in range(10)]
            t.create_edge(nodes[0], "NEXT", nodes[1])
            t.commit()

    found["ring_count"] = timed(lambda: (g.node_count(), g.edge_count()))
    found["ring_lookup"] = timed(lambda: g.nodes_with_label_and_property("Item", "name", "node_777").collect())
    found["ring_one_hop"] = timed(lambda: drained(s.query("MATCH (a:Item)-[:NEXT]->(b) RETURN id(a) AS a, id(b) AS b")))
    found["ring_incoming"] = timed(lambda: drained(g.in_degree("NEXT").filter(F.col("degree") > 0)))
    found["ring_two_hop"] = timed(lambda: s.query("MATCH (a:Item)-[:NEXT]->(b)-[:NEXT]->(c) RETURN count(*) AS n").collect())
    found["ring_small_commit"] = timed(small_commit)
    rates = {"loaded_per_s": round(NODES * (DEGREE + 1) / found["ring_load"]), "one_hop_edges_per_s": round(NODES * DEGREE / found["ring_one_hop"]), "incoming_edges_per_s": round(NODES * DEGREE / found["ring_incoming"]), "two_hop_paths_per_s": round(NODES * DEGREE**2 / found["ring_two_hop"])}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "rates": rates, "sf": SF, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
