"""Joins that make many more rows than their sides have."""

import pytest
from pyspark.sql import functions as F

from lodegraph import queries
from lodegraph.plans import planner
from lodegraph.session import Session
from lodegraph.sources.catalog import Graph

from .oracle import connect, same

SF01 = "/root/testdata/sf0.01"

SHARED = "MATCH (a:A)-[:IN]->(h:Hub), (b:B)-[:IN]->(h) WHERE a.v > 0 RETURN a.v AS a, b.v AS b"
THETA = "MATCH (a:A), (b:B) WHERE a.k = b.k AND a.v <> b.v RETURN a.v AS a, b.v AS b"


def hubs(spark, rows, keys=2):
    """``rows`` nodes of each label, three quarters of them at the first hub; the last has no key."""
    ends = spark.range(0, rows, 1, 1).select(F.col("id").alias("n"), F.when(F.col("id") < rows - 1, F.when(F.col("id") % 4 < 3, 0).otherwise(F.col("id") % keys)).alias("k"), F.col("id").alias("v"))
    g = Graph(spark).add_nodes("Hub", spark.range(keys).withColumnRenamed("id", "n"), "n").add_nodes("A", ends, "n").add_nodes("B", ends, "n")
    return g.add_rels("IN", ends, ("A", "n"), ("Hub", "k")).add_rels("IN", ends, ("B", "n"), ("Hub", "k"))


@pytest.fixture
def small(monkeypatch):
    """All joins of the planner that multiply rows are dealt out, and cut into small cells."""
    from lodegraph.plans import pairs

    for name, value in (("PAIRS", 40), ("SIDE", 3), ("FEW", 0)):
        monkeypatch.setattr(pairs, name, value)
    made = []
    monkeypatch.setattr(planner, "paired", lambda *a: (made.append(found := pairs.paired(*a)), found)[1])
    return made


@pytest.mark.parametrize("text", [SHARED, THETA])
def test_one_key_is_shared_by_many_tasks(spark, text):
    df = Session(hubs(spark, 6000)).query(text)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < sum(tasks) / 2


@pytest.mark.parametrize("name", ["shared_node", "theta_join"])
def test_dealt_rows_are_those_of_the_sql(spark, small, name):
    same(queries.QUERIES[name](spark, SF01), connect(SF01), queries.ORACLE_SQL[name])
    assert any(x is not None for x in small)


@pytest.mark.parametrize(
    "text",
    [
        SHARED,
        THETA,
        "MATCH (a:A), (b:B) WHERE a.v < b.v RETURN a.v AS a, b.v AS b",
        "MATCH (a:A), (b:B {v: 3}) WHERE b.k = a.k RETURN a.v AS a, b.v AS b",
        "MATCH (a:A)-[:IN]->(h:Hub)<-[:IN]-(b {v: 1}) RETURN a.v AS a, b.v AS b, labels(b)[0] AS l",
        "MATCH (a:A)-[:IN]->(h)<-[r:IN]-(b:A) WHERE a.k = b.k AND b.v > 2 RETURN a.v AS a, b.v AS b, type(r) AS t",
        "MATCH (a)-[:IN]-(h)-[:IN]-(b) RETURN a.v AS a, b.v AS b, labels(h)[0] AS l",
        "UNWIND [1, 1, 2] AS x MATCH (a:A) RETURN x, a.v AS a",
        "UNWIND [1, 1, 2] AS x MATCH (a:A {v: x}) MATCH (b:B) WHERE b.k = a.k RETURN x, a.v AS a, b.v AS b",
        "MATCH (a:A)-[:IN]->(h:Hub) OPTIONAL MATCH (h)<-[:IN]-(b:B)-[:IN]->(h)<-[:IN]-(c:A) WHERE b.v = c.v RETURN a.v AS a, c.v AS c",
        "MATCH (a:A)-[:IN]->(h:Hub) WHERE EXISTS { MATCH (h)<-[:IN]-(b:B) WHERE b.v < a.v } RETURN a.v AS a",
    ],
)
def test_dealt_rows_are_those_of_the_plain_join(spark, small, monkeypatch, text):
    g = hubs(spark, 23, 3)
    rows = lambda: sorted((tuple(r) for r in Session(g, extended=True).query(text).collect()), key=repr)
    dealt = rows()
    assert any(x is not None for x in small) and dealt
    monkeypatch.setattr(planner, "paired", lambda *a: None)
    assert rows() == dealt
