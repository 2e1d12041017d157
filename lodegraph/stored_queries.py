"""Registered queries over stored graphs and the typed interface, each with the SQL that must give the same rows."""

from __future__ import annotations

import io
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .admin import check_graph
from .catalog_tables import opened, text_graph
from .session import ExecuteOptions, Session
from .sources.store import Store, scratch_store


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark: SparkSession, sf_dir: str) -> Store:
    """Regions and nations, written through the typed interface; external ids are keys plus 1, and plus 101."""
    store = scratch_store(spark)
    with store.begin() as t:
        regions = t.create_nodes("Region", _read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("ext"), "r_name"), "ext")
        nations = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 101).alias("ext"), "n_name", "n_regionkey")
        nations = t.create_nodes("Nation", nations, "ext")
        ends = nations.join(F.broadcast(regions.select((F.col("ext") - 1).alias("n_regionkey"), F.col("id").alias("dst"))), "n_regionkey")
        t.create_edges("IN_REGION", ends.select(F.col("id").alias("src"), "dst", F.length("n_name").cast("long").alias("w")))
        t.commit()
    return store


def api_external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids by node, and one looked up there and back."""
    g = _nations(spark, sf_dir).graph()
    back = g.resolve_external(g.lookup_internal_id(107))
    return g.external_ids().select("ext", F.col("labels")[0].alias("label"), F.lit(back).alias("back"))


def api_bulk_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers and orders through the typed interface, then a pattern over them."""
    store = scratch_store(spark)
    with store.begin() as t:
        customers = t.create_nodes("Customer", _read(spark, sf_dir, "customer").select((2 * F.col("c_custkey") + 1).alias("ext"), "c_custkey"), "ext")
        orders = t.create_nodes("Order", _read(spark, sf_dir, "orders").select((2 * F.col("o_orderkey") + 2).alias("ext"), "o_orderkey", "o_custkey"), "ext")
        ends = orders.select(F.col("id").alias("dst"), F.col("o_custkey").alias("c_custkey")).join(customers.select(F.col("id").alias("src"), "c_custkey"), "c_custkey")
        t.create_edges("PLACED", ends.select("src", "dst"))
        t.commit()
    return Session(store.graph()).query("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, o.o_orderkey AS o")


def write_create_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:HAS {of: r.r_name}]->(:Capital {name: 'capital of ' + n.n_name})")
    return Session(store.graph()).query("MATCH (n:Nation)-[h:HAS]->(c:Capital) RETURN n.n_name AS n_name, h.of AS r_name, c.name AS capital")


def write_set_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.execute("MATCH (n:Nation)-[e:IN_REGION]->(r) WHERE n.n_regionkey > 1 SET n.size = e.w * 2, e.w = 0, n.n_regionkey = null")
    return Session(store.graph()).query("MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN n.n_name AS n_name, n.size AS size, n.n_regionkey AS k, e.w AS w")


def write_detach_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nations(spark, sf_dir)
    store.execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region {r_name: 'ASIA'}) DETACH DELETE n")
    return Session(store.graph(), extended=True).query("MATCH (r:Region) OPTIONAL MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.r_name AS r_name, n.n_name AS n_name")


def write_delete_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships deleted by themselves, then the nodes that are left alone."""
    store = _nations(spark, sf_dir)
    store.execute("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE e.w > 8 DELETE e")
    with store.begin() as t:
        alone = Session(store.graph(), extended=True).query("MATCH (n:Nation) WHERE NOT (n)-[:IN_REGION]->() RETURN id(n) AS id").collect()
        for r in alone:
            t.tombstone_node(r["id"])
        t.commit()
    return Session(store.graph()).query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.n_name AS n_name, r.r_name AS r_name")


def write_typed_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single entities through the typed interface: labels, properties, deletions, numbers of labels and types, compaction."""
    store = scratch_store(spark)
    regions = [r["r_name"] for r in _read(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    with store.begin() as t:
        ids = [t.create_node(k + 1, ("Place", "Old")) for k in range(len(regions))]
        for k, name in enumerate(regions):
            t.set_node_property(ids[k], "name", name)
            t.create_edge(ids[k], "NEXT", ids[(k + 1) % len(ids)])
            t.set_edge_property(ids[k], "NEXT", ids[(k + 1) % len(ids)], "k", k)
        t.commit()
    with store.begin() as t:
        t.add_node_label(ids[0], "First")
        t.remove_node_label(ids[1], "Old")
        t.set_node_property(ids[2], "rank", 7)
        t.remove_node_property(ids[3], "name")
        t.remove_edge_property(ids[0], "NEXT", ids[1], "k")
        t.tombstone_edge(ids[1], "NEXT", ids[2])
        t.tombstone_node(ids[4])
        number = t.get_or_create_label("Later"), t.get_or_create_type("NEVER")
        t.commit()
    store.checkpoint()
    g = store.graph()
    rows = [(k + 1, ":".join(sorted(g.node_labels(i))), g.node_label(i), json.dumps(g.node_properties(i), sort_keys=True), g.is_tombstoned(i), g.resolve_external(i)) for k, i in enumerate(ids)]
    rows.append((0, ",".join(f"{s - ids[0]}-{d - ids[0]}" for s, _, d in sorted(tuple(r)[:3] for r in g.neighbors(rel="NEXT").collect())), str(g.edge_property(ids[2], "NEXT", ids[3], "k")), json.dumps(g.edge_properties(ids[0], "NEXT", ids[1])), g.label_name(number[0]) == "Later" and g.type_id("NEVER") == number[1], g.node_count("Place")))
    return spark.createDataFrame(rows, "k long, labels string, first string, props string, gone boolean, ext long")


def api_nodes_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).nodes_with_label("Part").select("p_partkey", "p_name")


def api_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).all_nodes().select(F.col("labels")[0].alias("label"), F.coalesce("c_name", "s_name", "p_name", "n_name", "r_name").alias("name"))


def api_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of a node and of relationships."""
    g = opened(spark, sf_dir)
    nation, order = g.base("Nation") + 3, g.neighbors(g.base("Customer") + 7, "PLACED").agg(F.max("dst")).collect()[0][0]
    found = [("node_property", str(g.node_property(nation, "n_name"))), ("edge_property", str(g.edge_property(g.base("Customer") + 7, "PLACED", order, "date"))), ("missing", str(g.node_property(nation, "nothing")))]
    found += [(f"node {k}", str(v)) for k, v in g.node_properties(nation).items()] + [(f"edge {k}", str(v)) for k, v in g.edge_properties(g.base("Customer") + 7, "PLACED", order).items()]
    return spark.createDataFrame(found, "what string, found string")


def api_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of labels and types, there and back."""
    g = opened(spark, sf_dir)
    rows = [("label", x, g.label_name(g.label_id(x)) == x) for x in g.label_names()] + [("type", x, g.type_name(g.type_id(x)) == x) for x in g.type_names()]
    return spark.createDataFrame([*rows, ("none", None, g.label_id("Nothing") is None and g.type_name(99) is None)], "kind string, name string, same boolean")


def check_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the integrity checks find in the star-schema graph."""
    return check_graph(opened(spark, sf_dir)).select("kind", "detail", "n")


def explain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Session(opened(spark, sf_dir)).query("EXPLAIN MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_name")
    return plan.select(*[F.col("plan").contains(x).alias(x.lower()) for x in ("NodeScan", "Filter", "PushedFilters", "SortMergeJoin")])


def cli_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's rows, one JSON object a line."""
    out = io.StringIO()
    cli.show(Session(opened(spark, sf_dir)).query("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.n_name AS n, r.r_name AS r"), out)
    return spark.createDataFrame([tuple(json.loads(line).values()) for line in out.getvalue().splitlines()], "n string, r string")


def cli_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session at the prompt: parameters, a write and its status, a read, errors."""
    out, store = io.StringIO(), scratch_store(spark)
    lines = [":param name 'Ann'", ":param age 3", ":params", "CREATE (:Person {name: $name, age: $age}); // not read", ":unparam age", "MATCH (p:Person) WHERE p.name = $name RETURN p.age AS age", ":clearparams", ":params", "MATCH (", ":nothing", ":exit", "RETURN 1 AS never"]
    cli.repl(spark, store, False, lines, out)
    return spark.createDataFrame([(i, line.split(":")[0] if line.startswith("error") else line) for i, line in enumerate(out.getvalue().splitlines())], "i long, line string")


def execute_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within limits."""
    rows = Session(opened(spark, sf_dir)).rows("MATCH (r:Region) RETURN r.r_name AS r_name", options=ExecuteOptions(soft_timeout_ms=600_000, max_rows=5))
    return spark.createDataFrame([tuple(r) for r in rows], "r_name string")


def _text(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(text_graph(spark, sf_dir), extended=True).query(query)


_NATIONS = "nation join region on n_regionkey = r_regionkey"

OTHERS: dict[str, tuple[Callable, str]] = {
    "api_external_ids": (api_external_ids, "select r_regionkey + 1 as ext, 'Region' as label, cast(107 as bigint) as back from region union all select n_nationkey + 101, 'Nation', 107 from nation"),
    "api_bulk_write": (api_bulk_write, "select o_custkey as c, o_orderkey as o from orders"),
    "write_create_then_match": (write_create_then_match, f"select n_name, r_name, 'capital of ' || n_name as capital from {_NATIONS}"),
    "write_set_then_match": (write_set_then_match, "select n_name, case when n_regionkey > 1 then 2 * length(n_name) end as size, case when n_regionkey <= 1 then n_regionkey end as k, case when n_regionkey > 1 then 0 else length(n_name) end as w from nation"),
    "write_detach_then_match": (write_detach_then_match, "select r_name, n_name from region left join (select * from nation where n_regionkey <> (select r_regionkey from region where r_name = 'ASIA')) on n_regionkey = r_regionkey"),
    "write_delete_then_match": (write_delete_then_match, f"select n_name, r_name from {_NATIONS} where length(n_name) <= 8"),
    "write_typed_then_read": (write_typed_then_read, """select k, labels, first, props, gone, ext from (select r_regionkey + 1 as k, case r_regionkey when 0 then 'First:Old:Place' when 1 then 'Place' when 4 then '' else 'Old:Place' end as labels,
        case when r_regionkey < 4 then 'Place' end as first, case r_regionkey when 2 then '{"name": "' || r_name || '", "rank": 7}' when 3 then '{}' when 4 then '{}' else '{"name": "' || r_name || '"}' end as props,
        r_regionkey = 4 as gone, case when r_regionkey < 4 then r_regionkey + 1 end as ext from region) union all select 0, '0-1,2-3', '2', '{}', true, 4"""),
    "api_nodes_with_label": (api_nodes_with_label, "select p_partkey, p_name from part"),
    "api_nodes": (api_nodes, """select 'Region' as label, r_name as name from region union all select 'Nation', n_name from nation union all select 'Customer', c_name from customer union all select 'Supplier', s_name from supplier
        union all select 'Part', p_name from part union all select 'Order', null from orders union all select 'User', null from (select distinct user_id from events) union all select 'Event', null from events"""),
    "api_properties": (api_properties, """with n as (select * from nation where n_nationkey = 3), o as (select strftime(o_orderdate, '%Y-%m-%d') as d from orders where o_custkey = 7 order by o_orderkey desc limit 1)
        select 'node_property' as what, n_name as found from n union all select 'edge_property', coalesce((select d from o), 'None') union all select 'missing', 'None' union all select 'node n_nationkey', '3' union all select 'node n_name', n_name from n
        union all select 'node n_regionkey', cast(n_regionkey as varchar) from n union all select 'edge date', d from o"""),
    "api_names": (api_names, """select kind, name, true as same from (values ('label', 'Region'), ('label', 'Nation'), ('label', 'Customer'), ('label', 'Supplier'), ('label', 'Part'), ('label', 'Order'), ('label', 'User'), ('label', 'Event'),
        ('type', 'IN_REGION'), ('type', 'FROM_NATION'), ('type', 'PLACED'), ('type', 'EMITTED'), ('type', 'CONTAINS'), ('type', 'SUPPLIED_BY'), ('none', null)) as v(kind, name)"""),
    "check_integrity": (check_integrity, """select kind, detail, n from (
        select 'OrphanEdge' as kind, 'PLACED.src' as detail, count(*) as n from orders where o_custkey not in (select c_custkey from customer)
        union all select 'OrphanEdge', 'FROM_NATION.dst', count(*) from customer where c_nationkey not in (select n_nationkey from nation)
        union all select 'OrphanEdge', 'FROM_NATION.dst', count(*) from supplier where s_nationkey not in (select n_nationkey from nation)
        union all select 'OrphanEdge', 'IN_REGION.dst', count(*) from nation where n_regionkey not in (select r_regionkey from region)
        union all select 'OrphanEdge', 'CONTAINS.src', count(*) from (select distinct l_orderkey, l_partkey from lineitem) where l_orderkey not in (select o_orderkey from orders)
        union all select 'OrphanEdge', 'CONTAINS.dst', count(*) from (select distinct l_orderkey, l_partkey from lineitem) where l_partkey not in (select p_partkey from part)
        union all select 'OrphanEdge', 'SUPPLIED_BY.src', count(*) from (select distinct l_orderkey, l_suppkey from lineitem) where l_orderkey not in (select o_orderkey from orders)
        union all select 'OrphanEdge', 'SUPPLIED_BY.dst', count(*) from (select distinct l_orderkey, l_suppkey from lineitem) where l_suppkey not in (select s_suppkey from supplier)) where n > 0"""),
    "explain_filter": (explain_filter, "select true as nodescan, true as filter, true as pushedfilters, false as sortmergejoin"),
    "cli_rows": (cli_rows, f"select n_name as n, r_name as r from {_NATIONS}"),
    "cli_prompt": (cli_prompt, """select * from (values (cast(0 as bigint), '{"age": 3, "name": "Ann"}'), (1, '{"count": 1}'), (2, '{"age": 3}'), (3, '{}'), (4, 'error'), (5, 'error')) as v(i, line)"""),
    "execute_options": (execute_options, "select r_name from region"),
    "text_turns": (_text("MATCH (a:Turn {turn: 0})-[:NEXT*]->(b:Turn) RETURN a.conv_id AS conv_id, b.turn AS turn"),
                   "select b.conv_id, b.turn from conversations b where b.turn > 0 and b.conv_id in (select conv_id from conversations where turn = 0)"),
    "text_roles": (_text("MATCH (a:Turn)-[:NEXT]->(b:Turn) RETURN a.role AS r, b.role AS s, count(*) AS n"),
                   "select a.role as r, b.role as s, count(*) as n from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 group by 1, 2"),
    "text_documents": (_text("MATCH (d:Document) WHERE d.lang = 'en' RETURN d.source AS source, count(*) AS n, max(d.n_chars) AS longest"), "select source, count(*) as n, max(n_chars) as longest from documents where lang = 'en' group by 1"),
    "text_pages": (_text("MATCH (p:Page) WHERE p.url STARTS WITH 'http' RETURN p.page_id AS page_id, size(p.html) AS n"), "select page_id, length(html) as n from pages where starts_with(url, 'http')"),
}
