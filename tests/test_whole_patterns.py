"""Variable-length patterns without an upper bound."""

import pytest

from lodegraph.session import Session
from lodegraph.sources.catalog import Graph


@pytest.fixture(scope="module")
def turns(spark):
    g = Graph(spark).add_nodes("Turn", spark.createDataFrame([(k, f"t{k}") for k in range(13)], "k long, name string"), "k", ["name"])
    return g.add_rels("NEXT", spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long"), ("Turn", "a"), ("Turn", "b"))


def names(graph, text):
    return sorted(tuple(r) for r in Session(graph, extended=True).query(text).collect())


def test_a_chain_is_followed_to_its_end(turns):
    end = lambda low: sorted((f"t{a}", f"t{b}") for a in range(13) for b in range(a + low, 13))
    for text, low in (("*", 1), ("*2..", 2), ("*0..", 0), ("*20..", 20)):
        assert names(turns, f"MATCH (a:Turn)-[:NEXT{text}]->(b:Turn) RETURN a.name, b.name") == end(low)
    assert names(turns, "MATCH (b)<-[:NEXT*]-(a {name: 't0'}) WHERE b.name = 't12' RETURN a.name, b.name") == [("t0", "t12")]


def test_a_cycle_ends_as_a_relationship_is_taken_once(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 2), (0, 2)]
    g = Graph(spark).add_nodes("N", spark.createDataFrame([(k,) for k in range(3)], "k long"), "k", ["k"])
    g = g.add_rels("E", spark.createDataFrame(edges, "a long, b long"), ("N", "a"), ("N", "b"))

    def paths(at, left):
        for e in left:
            if e[0] == at:
                yield e[1]
                yield from paths(e[1], [x for x in left if x != e])

    assert names(g, "MATCH (a:N)-[:E*]->(b:N) RETURN a.k, b.k") == sorted((a, b) for a in range(3) for b in paths(a, edges))
    assert names(g, "MATCH (a:N)-[:E*]->(a) RETURN a.k") == sorted((a,) for a in range(3) for b in paths(a, edges) if a == b)
