"""Stored graphs: transactions, versions, checks, the command line and streams."""

import io
import json
from pathlib import Path

import pytest

from lodegraph.admin import check_graph, check_store
from lodegraph.cli import main
from lodegraph.errors import Conflict, Duplicate, NotFound, QueryRuntimeError, QuerySyntaxError, StorageError
from lodegraph.session import Session
from lodegraph.sources.store import Store
from lodegraph.streaming.ingest import edge_sink


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, str(tmp_path / "graph"))


def rows(store, text, extended=True):
    return sorted((tuple(r) for r in Session(store.graph(), extended).query(text).collect()), key=repr)


def test_create_match_set_delete(store):
    assert store.execute("CREATE (a:Person {name: 'Ann', age: 3})-[:KNOWS {since: 1}]->(b:Person {name: 'Bob'}), (a)-[:LIKES]->(:Thing)") == 5
    assert rows(store, "MATCH (a)-[r:KNOWS]->(b) RETURN a.name, r.since, b.name") == [("Ann", 1, "Bob")]
    assert store.execute("MATCH (a:Person) SET a.age = 10, a.tag = 'x'") == 4
    assert rows(store, "MATCH (a:Person) RETURN a.name, a.age, a.tag") == [("Ann", 10, "x"), ("Bob", 10, "x")]
    assert store.execute("MATCH (a:Person {name: 'Ann'}) SET a.age = null") == 1
    assert rows(store, "MATCH (a:Person) RETURN a.age") == [(10,), (None,)]
    assert store.execute("MATCH (a)-[r:KNOWS]->(b) SET r.since = r.since + 1") == 1
    assert rows(store, "MATCH ()-[r:KNOWS]->() RETURN r.since") == [(2,)]
    with pytest.raises(QueryRuntimeError):
        store.execute("MATCH (a:Person {name: 'Ann'}) DELETE a")
    assert store.execute("MATCH (a:Person {name: 'Ann'}) DETACH DELETE a") == 3
    assert rows(store, "MATCH (n) RETURN labels(n)[0]") == [("Person",), ("Thing",)]
    assert rows(store, "MATCH ()-[r]->() RETURN type(r)") == []
    assert check_store(store.spark, str(store.path)).count() == 0


def test_create_for_each_matched_row(store):
    store.execute("CREATE (:P {i: 1}), (:P {i: 2}), (:P {i: 3})")
    assert store.execute("MATCH (p:P) WHERE p.i > 1 CREATE (p)-[:HAS]->(:Q {of: p.i})") == 4
    assert rows(store, "MATCH (p:P)-[:HAS]->(q:Q) RETURN p.i, q.of") == [(2, 2), (3, 3)]
    ids = [r[0] for r in rows(store, "MATCH (n) RETURN id(n)")]
    assert len(set(ids)) == len(ids) == 5


def test_snapshots_and_rollback(store):
    store.execute("CREATE (:A {x: 1})")
    before = store.graph()
    with store.begin() as t:
        t.run("CREATE (:A {x: 2})")
    assert before.node_count() == store.graph().node_count() == 1
    store.execute("CREATE (:A {x: 'text'})")
    assert before.node_count() == 1
    assert rows(store, "MATCH (a:A) RETURN a.x") == [("1",), ("text",)]
    assert store.graph(1).node_count() == 1


def test_typed_transactions(store):
    with store.begin() as t:
        a, b = t.create_node(10, "A"), t.create_node(11, ("A", "B"))
        with pytest.raises(Duplicate):
            t.create_node(10, "A")
        with pytest.raises(Duplicate):
            t.create_node(0)
        t.create_edge(a, "R", b)
        t.create_edge(a, "R", b)
        t.set_node_property(a, "k", 5)
        t.set_edge_property(a, "R", b, "w", 1.5)
        with pytest.raises(NotFound):
            t.create_edge(a, "R", 99)
        t.commit()
    g = store.graph()
    assert g.edge_count() == 1
    assert g.node_property(a, "k") == 5
    assert g.edge_property(a, "R", b, "w") == 1.5
    with store.begin() as t:
        with pytest.raises(Duplicate):
            t.create_node(11)
        t.add_node_label(a, "C")
        t.remove_node_label(b, "B")
        t.remove_node_property(a, "k")
        t.set_node_property(a, "k", 6)  # a removal in the same transaction wins
        t.commit()
    g = store.graph()
    assert sorted(g.node_labels(a)) == ["A", "C"]
    assert g.node_labels(b) == ["A"]
    assert g.node_property(a, "k") is None
    with store.begin() as t:
        with pytest.raises(NotFound):
            t.tombstone_edge(b, "R", a)
        t.tombstone_node(b)
        t.commit()
    assert store.graph().edge_count() == 0
    assert store.graph().is_tombstoned(b)


def test_one_writer_and_formats(store, spark):
    with store.begin():
        with pytest.raises(Conflict):
            store.begin()
    with pytest.raises(StorageError):
        Store.create(spark, str(store.path))
    manifest = Path(store.path) / "manifest.json"
    for old in Path(store.path).glob(".manifest.json*crc"):
        old.unlink()
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"format": 99}))
    with pytest.raises(StorageError):
        Store.open(spark, str(store.path))


@pytest.mark.parametrize("text", ["CREATE (a)-[:R]-(b)", "CREATE (a)-[:R|S]->(b)", "MATCH (a) CREATE (a)", "MATCH (a) DELETE a.x", "MATCH (a) SET b.x = 1", "MATCH (a) RETURN a"])
def test_refused_statements(store, text):
    with pytest.raises(QuerySyntaxError):
        store.execute(text)


def test_integrity_checks_find_damage(store, spark):
    from lodegraph.sources.catalog import Graph, NodeTable, RelTable

    nodes = NodeTable(("A",), spark.createDataFrame([(1, 5), (1, 5), (None, 0)], "id long, _ext long"))
    edges = RelTable("R", ("A",), ("A",), spark.createDataFrame([(1, 9), (1, 9), (None, 1)], "src long, dst long"))
    kinds = {r["kind"] for r in check_graph(Graph(spark, [nodes], [edges])).collect()}
    assert kinds == {"NullNodeId", "ReservedExternalId", "DuplicateNodeId", "DuplicateExternalId", "NullEdgeEnd", "DuplicateEdge", "OrphanEdge"}


def test_command_line(spark, tmp_path):
    def run(*args):
        out = io.StringIO()
        return main([*args], spark, out), out.getvalue()

    folder = str(tmp_path / "g")
    assert run("write", folder, "CREATE (:A {x: $x})", "--params", '{"x": 4}') == (0, '{"count": 1}\n')
    code, text = run("query", folder, "MATCH (a:A) RETURN a, a.x AS x")
    assert code == 0
    assert json.loads(text)["x"] == 4
    assert json.loads(text)["a"]["internal_node_id"] == 0
    assert run("query", folder, "MATCH (a", "--params", "{}")[0] == 1
    assert run("query", folder, "RETURN 1", "--params", '{"x": 1.5}')[0] == 1
    assert run("check", folder) == (0, "")


def test_relationships_from_a_stream(spark, store, tmp_path):
    with store.begin() as t:
        ids = [t.create_node(i + 1, "A") for i in range(3)]
        t.commit()
    spark.createDataFrame([(ids[0], ids[1], 7), (ids[1], ids[2], 8)], "src long, dst long, w long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long, w long").parquet(str(tmp_path / "in"))
    q = edge_sink(stream, store, "R", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert rows(store, "MATCH (a)-[r:R]->(b) RETURN r.w") == [(7,), (8,)]


def paths(store):
    m = store.manifest()
    return {("/".join(e["labels"]) if "labels" in e else e["type"]): e["paths"] for e in [*m["nodes"], *m["rels"]]}


def test_a_commit_writes_what_changed(store):
    store.execute("CREATE (:A {x: 1})-[:R]->(:B {y: 2})")
    first = paths(store)
    with store.begin() as t:
        a = [t.create_node(100 + k, "A") for k in range(10)]
        t.create_edge(a[0], "S", a[1])
        t.commit()
    second = paths(store)
    assert (second["B"], second["R"]) == (first["B"], first["R"])
    assert second["A"][: len(first["A"])] == first["A"] and len(second["A"]) == len(first["A"]) + 1
    store.execute("MATCH (b:B) SET b.y = 3")
    third = paths(store)
    assert (third["A"], third["R"], third["S"]) == (second["A"], second["R"], second["S"]) and third["B"] != second["B"]
    with store.begin() as t:
        t.create_nodes("A", store.spark.createDataFrame([(500, "text")], "ext long, x string"), "ext")  # x is of another kind now
        t.commit()
    assert len(paths(store)["A"]) == 1
    assert rows(store, "MATCH (a:A) WHERE a.x IS NOT NULL RETURN a.x") == [("1",), ("text",)]
    assert store.graph().node_count("A") == 12


def test_compaction_and_vacuum(store):
    for k in range(4):
        store.execute(f"CREATE (:A {{x: {k}}})-[:R {{w: {k}}}]->(:A)")
    before = rows(store, "MATCH (a)-[r:R]->(b) RETURN a.x, r.w, id(b)")
    assert len(paths(store)["A"]) == 4
    version = store.checkpoint()
    assert len(paths(store)["A"]) == len(paths(store)["R"]) == 1
    assert store.checkpoint() == version
    assert store.graph(2).node_count() == 4
    assert store.vacuum() > 0
    with pytest.raises(NotFound):
        store.graph(2)
    assert not [x for x in store.files.names() if x.startswith("staged")]
    assert rows(store, "MATCH (a)-[r:R]->(b) RETURN a.x, r.w, id(b)") == before


def test_external_ids_are_kept(store):
    with store.begin() as t:
        a = t.create_node(77, "A")
        t.set_node_property(a, "k", 1)
        t.commit()
    with store.begin() as t:
        t.add_node_label(a, "B")
        t.set_node_property(a, "k", 2)
        t.commit()
    g = store.graph()
    assert (g.resolve_external(a), g.lookup_internal_id(77), g.lookup_internal_id(78)) == (77, a, None)
    assert g.node_properties(a) == {"k": 2} and g.node_labels(a) == ["A", "B"]
    assert rows(store, "MATCH (n) RETURN keys(n)") == [(["k"],)]


def test_bulk_rows_are_validated(store, spark):
    with store.begin() as t:
        t.create_node(5, "A")
        t.commit()
    for ext in ([(0,)], [(9,), (9,)], [(5,)], [(None,)]):
        with store.begin() as t:
            t.create_nodes("A", spark.createDataFrame(ext, "ext long"), "ext")
            with pytest.raises(Duplicate):
                t.commit()
    with store.begin() as t:
        new = t.create_nodes("B", spark.createDataFrame([(9, "x"), (10, None)], "ext long, name string"), "ext")
        assert sorted(r["ext"] for r in new.collect()) == [9, 10]
        t.create_edges("R", new.selectExpr("id as src", "99 as dst"))
        with pytest.raises(NotFound):
            t.commit()
    assert store.graph().node_count() == 1
    assert [x for x in store.files.names() if x.startswith("v")] == [x for x in store.files.names() if x.startswith("v1-")]


def test_an_edge_made_again_takes_new_properties(store):
    with store.begin() as t:
        a, b = t.create_node(1, "A"), t.create_node(2, "A")
        t.create_edge(a, "R", b)
        t.set_edge_property(a, "R", b, "v", 1)
        t.set_edge_property(a, "R", b, "w", 1)
        t.commit()
    with store.begin() as t:
        t.create_edge(a, "R", b)
        t.commit()
    with store.begin() as t:
        t.create_edge(a, "R", b)
        t.set_edge_property(a, "R", b, "w", 2)
        t.commit()
    assert store.graph().edge_count() == 1
    assert store.graph().edge_properties(a, "R", b) == {"v": 1, "w": 2}


def test_the_lock_of_a_lost_writer_falls(store, monkeypatch):
    from lodegraph.sources import store as module

    monkeypatch.setattr(module, "LEASE", -1)
    lost = store.begin()
    lost.run("CREATE (:A)")
    monkeypatch.setattr(module, "LEASE", 3600)
    with store.begin() as t:
        with pytest.raises(Conflict):
            lost.commit()
        with pytest.raises(Conflict):
            store.begin()
        t.run("CREATE (:B)")
        t.renew()
        assert t.commit() == 1
    lost.rollback()
    assert rows(store, "MATCH (n) RETURN labels(n)[0]") == [("B",)]


def test_versions_are_published_once(store):
    with store.begin() as t:
        t.run("CREATE (:A)")
        other = store.manifest() | {"version": 1}
        store.files.create("manifest-1.json", json.dumps(other))  # made by a writer that was lost before putting it in place
        with pytest.raises(Conflict):
            t.commit()
    assert store.manifest()["version"] == 0
    assert store.execute("CREATE (:A)") == 1
    assert store.manifest()["version"] == 2


def test_numbers_of_labels_survive_a_rollback(store):
    with store.begin() as t:
        assert (t.get_or_create_label("X"), t.get_or_create_label("Y"), t.get_or_create_label("X"), t.get_or_create_type("R")) == (0, 1, 0, 0)
    g = store.graph()
    assert (g.label_id("Y"), g.label_name(0), g.type_name(0), g.label_id("Z")) == (1, "X", "R", None)
    store.execute("CREATE (:Z)")
    assert store.graph().label_id("Z") == 2


def test_repair(store, spark):
    from lodegraph.admin import repair_store

    store.execute("CREATE (:A {x: 1})-[:R]->(:A {x: 2}), (:B)")
    assert repair_store(spark, store.path) == 1
    kept = paths(store)["B"]
    m = store.manifest()
    e = next(x for x in m["rels"])
    spark.createDataFrame([(0, 99), (0, 1)], "src long, dst long").write.parquet(f"{store.path}/broken")
    store._publish(m | {"version": 2, "rels": [e | {"paths": [*e["paths"], "broken"]}]})
    assert {r["kind"] for r in check_store(spark, store.path).collect()} == {"OrphanEdge", "DuplicateEdge"}
    assert repair_store(spark, store.path) == 3
    assert check_store(spark, store.path).isEmpty()
    assert rows(store, "MATCH (a)-[:R]->(b) RETURN a.x, b.x") == [(1, 2)]
    assert paths(store)["B"] == kept


def test_limits(store):
    from lodegraph.errors import ResourceLimitExceeded
    from lodegraph.session import ExecuteOptions

    store.execute("CREATE (:A {x: 1}), (:A {x: 2})")
    s = Session(store.graph())
    assert len(s.rows("MATCH (a:A) RETURN a.x", options=ExecuteOptions(None, 2))) == 2
    with pytest.raises(ResourceLimitExceeded):
        s.rows("MATCH (a:A) RETURN a.x", options=ExecuteOptions(None, 1))
    slow = "UNWIND range(1, 30000) AS i RETURN size([x IN range(1, 10000) WHERE x % 7 = i % 7]) AS n"
    with pytest.raises(ResourceLimitExceeded):
        Session(store.graph(), extended=True).rows(slow, options=ExecuteOptions(500))
