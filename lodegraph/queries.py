"""Registered queries over the star-schema graph, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored_queries
from .catalog_tables import opened, ring_graph
from .session import Session

#: Name: (query, SQL, parameters, extended).
CYPHER: dict[str, tuple[str, str, dict, bool]] = {}


def _add(name: str, text: str, sql: str, params: dict | None = None, extended: bool = False) -> None:
    CYPHER[name] = (text, sql, params or {}, extended)


# -- scans, filters, limits
_add("return_const", "RETURN 1 AS a, 'x' AS b, true AS c, 2.5 AS d", "select cast(1 as bigint) a, 'x' b, true c, cast(2.5 as double) d")
_add("scan_label", "MATCH (n:Nation) RETURN n.n_name AS n_name", "select n_name from nation")
_add("scan_all", "MATCH (n) RETURN labels(n)[0] AS label, n.r_name AS r_name, n.n_name AS n_name",
     """select 'Region' as label, r_name, null as n_name from region union all select 'Nation', null, n_name from nation union all select 'Customer', null, null from customer
     union all select 'Supplier', null, null from supplier union all select 'Part', null, null from part union all select 'Order', null, null from orders
     union all select 'User', null, null from (select distinct user_id from events) union all select 'Event', null, null from events""")  # fmt: skip
_add("filter_eq_string", "MATCH (c:Customer) WHERE c.c_mktsegment = 'BUILDING' RETURN c.c_name AS c_name", "select c_name from customer where c_mktsegment = 'BUILDING'")
_add("filter_eq_int", "MATCH (p:Part) WHERE p.p_size = 10 RETURN p.p_name AS p_name", "select p_name from part where p_size = 10")
_add("filter_numeric_eq", "MATCH (p:Part) WHERE p.p_size = 10.0 RETURN p.p_name AS p_name", "select p_name from part where p_size = 10")
_add("inline_map", "MATCH (p:Part {p_size: 10, p_brand: 'Brand#17'}) RETURN p.p_name AS p_name", "select p_name from part where p_size = 10 and p_brand = 'Brand#17'")
_add("param_eq", "MATCH (n:Nation) WHERE n.n_name = $name RETURN n.n_nationkey AS k", "select cast(n_nationkey as bigint) k from nation where n_name = 'NATION_7'", {"name": "NATION_7"})
_add("param_missing", "MATCH (n:Nation) WHERE n.n_name = $other RETURN n.n_name AS n_name", "select n_name from nation where false")
_add("limit_ordered", "MATCH (c:Customer) RETURN c.c_name AS c_name LIMIT 5", "select c_name from customer order by c_custkey limit 5")
_add("limit_arith", "MATCH (c:Customer) RETURN c.c_name AS c_name LIMIT 2 * $n", "select c_name from customer order by c_custkey limit 6", {"n": 3})
_add("limit_zero", "MATCH (c:Customer) RETURN c.c_name AS c_name LIMIT 0", "select c_name from customer limit 0")
_add("unknown_label", "MATCH (x:Nowhere) RETURN labels(x) AS l", "select ['x'] as l from region where false")
_add("unknown_property", "MATCH (r:Region) RETURN r.nothing IS NULL AS missing", "select true as missing from region")
_add("default_names", "MATCH (p:Part) RETURN p.p_size, p.p_size + 1, toUpper(p.p_name)", 'select cast(p_size as bigint) as "p.p_size", cast(p_size as bigint) + 1 as "p.p_size + 1", upper(p_name) as "toupper(p.p_name)" from part')
# -- patterns
_add("hop1", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n_name, r.r_name AS r_name", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
_add("hop2", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_name = 'ASIA' RETURN c.c_name AS c_name, n.n_name AS n_name",
     "select c_name, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
_add("hop3", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:FROM_NATION]->(n)-[:IN_REGION]->(r) WHERE o.o_totalprice > 400000 RETURN o.o_orderstatus AS o_orderstatus, c.c_name AS c_name, r.r_name AS r_name",
     "select o_orderstatus, c_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_totalprice > 400000")
_add("hop4", "MATCH (p:Part)<-[:CONTAINS]-(o:Order)<-[:PLACED]-(c:Customer)-[:FROM_NATION]->(n:Nation) WHERE p.p_size = 3 RETURN p.p_name AS p_name, c.c_name AS c_name, n.n_name AS n_name",
     "select p_name, c_name, n_name from (select distinct l_orderkey, l_partkey from lineitem) join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where p_size = 3")
_add("incoming", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r_name, n.n_name AS n_name", "select r_name, n_name from region join nation on n_regionkey = r_regionkey")
_add("undirected", "MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.n_name AS n_name, r.r_name AS r_name", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
_add("undirected_both", "MATCH (a)-[:IN_REGION]-(b) RETURN labels(a)[0] AS a, labels(b)[0] AS b", "select 'Nation' as a, 'Region' as b from nation union all select 'Region', 'Nation' from nation")
_add("any_type", "MATCH (n:Nation)-[r]->(x) RETURN type(r) AS t, x.r_name AS r_name", "select 'IN_REGION' as t, r_name from nation join region on n_regionkey = r_regionkey")
_add("type_union", "MATCH (x)-[:FROM_NATION|IN_REGION]->(y) RETURN y.n_name AS n_name, y.r_name AS r_name",
     """select n_name, null as r_name from customer join nation on c_nationkey = n_nationkey union all select n_name, null from supplier join nation on s_nationkey = n_nationkey
     union all select null, r_name from nation join region on n_regionkey = r_regionkey""")  # fmt: skip
_add("unknown_type", "MATCH (n:Nation)-[:NOWHERE]->(x) RETURN n.n_name AS n_name", "select n_name from nation where false")
_add("cycle", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation)<-[:FROM_NATION]-(c) RETURN c.c_name AS c_name", "select c_name from customer where false")
_add("shared_node", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation), (s:Supplier)-[:FROM_NATION]->(n) WHERE c.c_acctbal > 9000 RETURN c.c_name AS c_name, s.s_name AS s_name",
     "select c_name, s_name from customer join supplier on c_nationkey = s_nationkey where c_acctbal > 9000")
_add("two_matches", "MATCH (c:Customer) MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 450000 RETURN c.c_name AS c_name, o.o_orderkey AS k", "select c_name, o_orderkey as k from customer join orders on o_custkey = c_custkey where o_totalprice > 450000")
_add("cross_filter", "MATCH (s:Supplier), (r:Region) WHERE s.s_acctbal > 9000 RETURN s.s_name AS s_name, r.r_name AS r_name", "select s_name, r_name from supplier, region where s_acctbal > 9000")
_add("theta_join", "MATCH (a:Supplier), (b:Supplier) WHERE a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal RETURN a.s_name AS a, b.s_name AS b", "select a.s_name a, b.s_name b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal")
_add("bound_rel", "MATCH (n:Nation)-[r:IN_REGION]->(x) MATCH (a)-[r]->(b:Region) RETURN n.n_name AS n_name, b.r_name AS r_name", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
_add("edge_unique", "MATCH (a:Nation)-[:IN_REGION]->(r:Region)<-[:IN_REGION]-(b:Nation) RETURN a.n_name AS a, b.n_name AS b", "select a.n_name a, b.n_name b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
_add("collapsed_edge", "MATCH (o:Order)-[:CONTAINS]->(p:Part) WHERE p.p_brand = 'Brand#17' RETURN o.o_totalprice AS o_totalprice, p.p_name AS p_name",
     "select o_totalprice, p_name from (select distinct l_orderkey, l_partkey from lineitem) l join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where p_brand = 'Brand#17'")
_add("rel_property", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.qty > 90 RETURN o.o_orderkey AS o, p.p_partkey AS p, r.qty AS qty",
     "select l_orderkey as o, l_partkey as p, sum(cast(l_quantity as double)) as qty from lineitem group by 1, 2 having sum(l_quantity) > 90")
_add("rel_inline_map", "MATCH (c:Customer)-[:PLACED {date: '1995-03-15'}]->(o) RETURN c.c_name AS c_name, o.o_orderkey AS k", "select c_name, o_orderkey as k from customer join orders on o_custkey = c_custkey where strftime(o_orderdate, '%Y-%m-%d') = '1995-03-15'")
_add("user_events", "MATCH (u:User)-[:EMITTED]->(e:Event) WHERE e.event_type = 'purchase' AND e.value > 50 RETURN u.user_id AS user_id, e.event_id AS event_id", "select user_id, event_id from events where event_type = 'purchase' and value > 50")
# -- expressions
_add("cmp_range", "MATCH (p:Part) WHERE p.p_size >= 10 AND p.p_size < 20 AND p.p_size <> 15 RETURN p.p_partkey AS k", "select p_partkey as k from part where p_size >= 10 and p_size < 20 and p_size <> 15")
_add("cmp_chain", "MATCH (p:Part) WHERE 10 <= p.p_size < 20 RETURN p.p_partkey AS k", "select p_partkey as k from part where p_size >= 10 and p_size < 20")
_add("bool_logic", "MATCH (p:Part) WHERE NOT (p.p_size > 10 OR p.p_brand = 'Brand#17') AND p.p_size > 3 RETURN p.p_partkey AS k", "select p_partkey as k from part where not (p_size > 10 or p_brand = 'Brand#17') and p_size > 3")
_add("xor", "MATCH (p:Part) WHERE p.p_size > 25 XOR p.p_brand = 'Brand#17' RETURN p.p_partkey AS k", "select p_partkey as k from part where (p_size > 25) <> (p_brand = 'Brand#17')")
_add("kleene", "RETURN (null AND false) AS a, (null OR true) AS b, (null AND true) IS NULL AS c, (NOT null) IS NULL AS d, (null XOR true) IS NULL AS e", "select false a, true b, true c, true d, true e")
_add("is_null", "MATCH (n) WHERE n.r_name IS NOT NULL OR n.n_name IS NOT NULL RETURN n.r_name IS NULL AS a, n.n_name AS b", "select false a, null as b from region union all select true, n_name from nation")
_add("in_list", "MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, 5] RETURN n.n_name AS n_name", "select n_name from nation where n_nationkey in (1, 3, 5)")
_add("in_null", "RETURN (null IN []) AS a, (1 IN [null]) IS NULL AS b, (1 IN [1, null]) AS c, (null IN [1]) IS NULL AS d, (1 IN null) IS NULL AS e", "select false a, true b, true c, true d, true e")
_add("starts_ends_contains", "MATCH (p:Part) WHERE p.p_name STARTS WITH 'r' AND p.p_name ENDS WITH 'g' OR p.p_name CONTAINS 'late' RETURN p.p_partkey AS k", "select p_partkey as k from part where starts_with(p_name, 'r') and p_name like '%g' or p_name like '%late%'")
_add("arith_int", "MATCH (p:Part) RETURN p.p_size / 3 AS q, p.p_size % 3 AS m, p.p_size ^ 2 AS sq", "select cast(p_size as bigint) // 3 as q, cast(p_size as bigint) % 3 as m, cast(pow(p_size, 2) as double) as sq from part")
_add("arith_signs", "RETURN -7 / 2 AS a, -7 % 3 AS b, 7 % -3 AS c, 2 ^ 3 ^ 2 AS d, -(3) AS e, 2 + 3 * 4 - 1 AS f", "select cast(-3 as bigint) a, cast(-1 as bigint) b, cast(1 as bigint) c, cast(64 as double) d, cast(-3 as bigint) e, cast(13 as bigint) f")
_add("arith_float", "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_acctbal * 2 + 1.5 AS x, c.c_acctbal / 4 AS y", "select c_custkey as k, c_acctbal * 2 + 1.5 as x, c_acctbal / 4 as y from customer")
_add("div_zero", "RETURN (1 / 0) IS NULL AS a, (1 % 0) IS NULL AS b, 1.0 / 0 > 1e300 AS c, (0.0 / 0) = (0.0 / 0) AS d", "select true a, true b, true c, false d")
_add("int_overflow", "RETURN 9223372036854775807 + 1 AS a, -9223372036854775808 AS b", "select cast(9223372036854775808 as double) a, cast(-9223372036854775808 as bigint) b")
_add("type_mismatch_eq", "MATCH (r:Region) RETURN r.r_name = 1 AS a, r.r_name <> 1 AS b, (r.r_name < 1) IS NULL AS c", "select false a, true b, true c from region")
_add("list_equality", "RETURN [1, 2] = [1, 2] AS a, ([1, null] = [1, null]) IS NULL AS b, [1] = [1, 2] AS c, [1, 2] < [1, 3] AS d, {a: 1} = {a: 1.0} AS e", "select true a, true b, false c, true d, true e")
_add("concat_plus", "MATCH (n:Nation) RETURN n.n_name + '!' AS a, [n.n_nationkey] + 7 AS b, ('x' + 1) IS NULL AS c", "select n_name || '!' a, [cast(n_nationkey as bigint), 7] b, true c from nation")
_add("case_simple", "MATCH (n:Nation) RETURN CASE n.n_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS k", "select case n_nationkey when 1 then 'one' when 2 then 'two' else 'many' end k from nation")
_add("case_searched", "MATCH (c:Customer) RETURN c.c_name AS c_name, CASE WHEN c.c_acctbal > 5000 THEN 'hi' WHEN c.c_acctbal > 0 THEN 'mid' ELSE 'lo' END AS k", "select c_name, case when c_acctbal > 5000 then 'hi' when c_acctbal > 0 then 'mid' else 'lo' end as k from customer")
_add("label_predicate", "MATCH (x)-[r]->(y) WHERE x:Customer AND y:Nation AND r:FROM_NATION RETURN y.n_name AS n_name", "select n_name from customer join nation on c_nationkey = n_nationkey")
_add("index_slice", "MATCH (p:Part) RETURN split(p.p_name, ' ')[0] AS a, split(p.p_name, ' ')[-1] AS b, split(p.p_name, ' ')[9] IS NULL AS c, split(p.p_name, ' ')[0..1] AS d, [1, 2, 3, 4][-2..] AS e",
     "select string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[-1] b, true c, string_split(p_name, ' ')[1:1] d, [cast(3 as bigint), 4] e from part")
_add("map_access", "MATCH (n:Nation) RETURN {a: n.n_nationkey, b: n.n_name}.b AS b, {a: n.n_nationkey}['a'] AS a", "select n_name b, cast(n_nationkey as bigint) a from nation")
# -- functions
_add("fn_string", "MATCH (n:Nation) RETURN toLower(n.n_name) AS l, substring(n.n_name, 0, 3) AS s, size(n.n_name) AS z", "select lower(n_name) l, substring(n_name, 1, 3) s, cast(length(n_name) as bigint) z from nation")
_add("fn_string_more", "MATCH (p:Part) RETURN left(p.p_name, 3) AS a, right(p.p_name, 2) AS b, replace(p.p_name, 'e', 'E') AS c, reverse(p.p_name) AS d, split(p.p_name, ' ') AS e, substring(p.p_name, 2) AS f, trim('  x ') AS g, ltrim(' y ') AS h, rtrim(' z ') AS i",
     "select left(p_name, 3) a, right(p_name, 2) b, replace(p_name, 'e', 'E') c, reverse(p_name) d, string_split(p_name, ' ') e, substring(p_name, 3) f, 'x' g, 'y ' h, ' z' i from part")
_add("fn_documents", "RETURN toUpper('straße') AS a, size('ñandú') AS b, left('abc', -1) AS c, substring('abc', 9) AS d, split('a.b', '.') AS e", "select 'STRASSE' a, cast(5 as bigint) b, '' c, '' d, ['a', 'b'] e")
_add("fn_math", "MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS b, floor(c.c_acctbal) AS d, round(c.c_acctbal) AS r, sign(c.c_acctbal) AS s, sqrt(abs(c.c_acctbal)) AS q",
     "select c_custkey as k, abs(c_acctbal) a, cast(ceil(c_acctbal) as double) b, cast(floor(c_acctbal) as double) d, cast(round(c_acctbal) as double) r, cast(sign(c_acctbal) as bigint) s, sqrt(abs(c_acctbal)) q from customer")
_add("fn_math_const", "RETURN round(-2.5) AS a, log(e()) AS b, log(2, 8) AS c, log(0) IS NULL AS d, log(1, 5) IS NULL AS f, rand() AS g, pi() > 3.14 AS h, sign(-3) AS i, abs(-4) AS j",
     "select cast(-3 as double) a, cast(1 as double) b, cast(3 as double) c, true d, true f, cast(0.42 as double) g, true h, cast(-1 as bigint) i, cast(4 as bigint) j")
_add("fn_cast", "RETURN toInteger('12') AS a, toInteger('1.9') AS b, toInteger(' 1') IS NULL AS c, toInteger(-2.7) AS d, toFloat('1.5') AS e, toFloat('x') IS NULL AS f, toBoolean('TRUE') AS g, toBoolean('no') IS NULL AS h, toString(1.0) AS i, toString(true) AS j, toString(2.5) AS k",
     "select cast(12 as bigint) a, cast(1 as bigint) b, true c, cast(-2 as bigint) d, cast(1.5 as double) e, true f, true g, true h, '1' i, 'true' j, '2.5' k")
_add("fn_list", "RETURN head([1, 2]) AS a, last([1, 2]) AS b, tail([1, 2, 3]) AS c, size([1, 2]) AS d, reverse([1, 2]) AS e, range(1, 7, 3) AS f, range(3, 1) AS g, range(3, 1, -1) AS h, coalesce(null, 5) AS i, head([]) IS NULL AS j, range(1, 2, 0) IS NULL AS k",
     "select cast(1 as bigint) a, cast(2 as bigint) b, [cast(2 as bigint), 3] c, cast(2 as bigint) d, [cast(2 as bigint), 1] e, [cast(1 as bigint), 4, 7] f, cast([] as bigint[]) g, [cast(3 as bigint), 2, 1] h, cast(5 as bigint) i, true j, true k")
_add("quant_any", "MATCH (p:Part) WHERE any(w IN split(p.p_name, ' ') WHERE w STARTS WITH 'r') RETURN p.p_name AS p_name", "select p_name from part where len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'r'))) > 0")
_add("quant_all", "MATCH (p:Part) WHERE all(w IN split(p.p_name, ' ') WHERE size(w) > 3) RETURN p.p_name AS p_name", "select p_name from part where len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3)) = len(string_split(p_name, ' '))")
_add("quant_none", "MATCH (p:Part) WHERE none(w IN split(p.p_name, ' ') WHERE w CONTAINS 'e') RETURN p.p_name AS p_name", "select p_name from part where len(list_filter(string_split(p_name, ' '), lambda w: w like '%e%')) = 0")
_add("quant_single", "MATCH (p:Part) WHERE single(w IN split(p.p_name, ' ') WHERE w CONTAINS 'e') RETURN p.p_name AS p_name", "select p_name from part where len(list_filter(string_split(p_name, ' '), lambda w: w like '%e%')) = 1")
_add("quant_null", "RETURN any(x IN [null, 1] WHERE x > 1) IS NULL AS a, all(x IN [] WHERE x > 1) AS b, none(x IN [1] WHERE x > 1) AS c, single(x IN [1, null] WHERE x = 1) IS NULL AS d", "select true a, true b, true c, true d")
_add("reduce_sum", "MATCH (p:Part) RETURN reduce(s = 0, w IN split(p.p_name, ' ') | s + size(w)) AS n", "select cast(list_sum(list_transform(string_split(p_name, ' '), lambda w: length(w))) as bigint) n from part")
_add("fn_labels_type", "MATCH (n:Nation)-[r]->(x:Region) RETURN labels(n) AS a, type(r) AS b, labels(x) AS c", "select ['Nation'] a, 'IN_REGION' b, ['Region'] c from nation")
_add("fn_keys", "MATCH (n:Region) RETURN keys(n) AS a, keys({b: 1, a: 2}) AS b", "select ['r_name', 'r_regionkey'] a, ['a', 'b'] b from region")
_add("fn_properties", "MATCH (n:Region) RETURN properties(n).r_name AS a", "select r_name a from region")
_add("start_end_node", "MATCH (n:Nation)-[r:IN_REGION]->(x) RETURN startNode(r).n_name AS a, endNode(r).r_name AS b", "select n_name a, r_name b from nation join region on n_regionkey = r_regionkey")
_add("fn_id", "MATCH (a:Nation)-[r:IN_REGION]->(b) RETURN id(a) = id(r) AS x, id(a) <> id(b) AS y", "select true x, true y from nation")
# -- temporal
_add("temporal_truncate", "MATCH (e:Event) RETURN e.event_id AS k, date.truncate('month', e.day) AS m, date.truncate('week', date(e.day)) AS w, date.truncate('quarter', date(e.day)) AS q, date.truncate('decade', date(e.day)) AS d",
     "select event_id k, strftime(date_trunc('month', ts), '%Y-%m-%d') m, strftime(date_trunc('week', ts), '%Y-%m-%d') w, strftime(date_trunc('quarter', ts), '%Y-%m-%d') q, strftime(date_trunc('decade', ts), '%Y-%m-%d') d from events")
_add("temporal_accessors", "MATCH (e:Event) RETURN e.event_id AS k, date(e.day).year AS y, date(e.day).month AS m, date(e.day).day AS d, date(e.day).quarter AS q, date(e.day).week AS w, date(e.day).weekDay AS wd, date(e.day).ordinalDay AS od, date(e.day).weekYear AS wy",
     "select event_id k, year(ts) y, month(ts) m, day(ts) d, quarter(ts) q, week(ts) w, isodow(ts) wd, dayofyear(ts) od, isoyear(ts) wy from events")
_add("temporal_arith", "MATCH (e:Event) RETURN e.event_id AS k, date(e.day) + duration({months: 1, days: 3}) AS a, date(e.day) - duration('P1Y') AS b",
     "select event_id k, strftime(cast(ts as date) + interval 1 month + interval 3 day, '%Y-%m-%d') a, strftime(cast(ts as date) - interval 12 month, '%Y-%m-%d') b from events")
_add("temporal_compare", "MATCH (e:Event) WHERE date(e.day) < date('2024-01-10') RETURN e.event_id AS k", "select event_id k from events where cast(ts as date) < date '2024-01-10'")
_add("temporal_between", "MATCH (e:Event) RETURN e.event_id AS k, duration.inDays(date('2020-01-01'), date(e.day)).days AS d, duration.inMonths(date('2020-01-01'), date(e.day)).months AS m",
     "select event_id k, cast(cast(ts as date) - date '2020-01-01' as bigint) d, cast((year(ts) - 2020) * 12 + month(ts) - 1 as bigint) m from events")
_add("temporal_forms", "RETURN date('2020-W05-3') AS a, date('2020-032') AS b, date('20200229') AS c, date('2020-13-01') IS NULL AS d, localtime('10:11:12.5') AS e, time('1011+0230') AS f, localdatetime('2020-01-01T10:00') AS g, datetime('2020-01-01T10:00Z') AS h, date() AS i, datetime.fromEpoch(86400) AS j",
     "select '2020-01-29' a, '2020-02-01' b, '2020-02-29' c, true d, '10:11:12.5' e, '10:11+02:30' f, '2020-01-01T10:00' g, '2020-01-01T10:00Z' h, '1970-01-01' i, '1970-01-02T00:00Z' j")
_add("temporal_maps", "RETURN date({year: 2020, month: 2}) AS a, date({year: 2020, week: 5, dayOfWeek: 3}) AS b, date({year: 2020, quarter: 2, dayOfQuarter: 3}) AS c, localdatetime({year: 2020, hour: 5, millisecond: 7}) AS d, datetime({year: 2020, timezone: 'Europe/Stockholm'}) AS e, time({hour: 3, timezone: '-05:00'}) AS f",
     "select '2020-02-01' a, '2020-01-29' b, '2020-04-03' c, '2020-01-01T05:00:00.007' d, '2020-01-01T00:00+01:00[Europe/Stockholm]' e, '03:00-05:00' f")
_add("duration_forms", "RETURN duration('P1Y2M3DT4H5M6.5S') AS a, duration({days: 1.5}) AS b, duration({months: 14}).years AS c, duration('PT90M').hours AS d, duration('P1D') + duration('PT1H') AS e, duration('P2DT2H') * 2 AS f, duration('P3D') / 2 AS g, duration({}) AS h, duration.between(date('2020-01-31'), date('2021-03-01')) AS i, duration.between(date('2021-03-01'), date('2020-01-31')) AS j",
     "select 'P1Y2M3DT4H5M6.5S' a, 'P1DT12H' b, cast(1 as bigint) c, cast(1 as bigint) d, 'P1DT1H' e, 'P4DT4H' f, 'P1DT12H' g, 'PT0S' h, 'P1Y1M1D' i, 'P-1Y-1M-1D' j")
_add("comments", "/* nations */ MATCH (n:Nation) // by name\n RETURN n.n_name AS n_name; what follows is not read", "select n_name from nation")
# -- beyond the basic language
_add("return_star", "MATCH (n:Nation)-[:IN_REGION]->(r) WITH n.n_name AS n_name, r.r_name AS r_name RETURN *", "select n_name, r_name from nation join region on n_regionkey = r_regionkey", extended=True)
_add("x_varlen", "MATCH (c:Supplier)-[:FROM_NATION|IN_REGION*1..2]->(x) RETURN c.s_suppkey AS c, x.n_name AS n, x.r_name AS r",
     """select s_suppkey c, n_name n, null as r from supplier join nation on s_nationkey = n_nationkey
     union all select s_suppkey, null, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""", extended=True)  # fmt: skip
_add("x_count", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(*) AS n, count(DISTINCT c.c_mktsegment) AS k", "select count(*) n, count(distinct c_mktsegment) k from customer join orders on o_custkey = c_custkey", extended=True)
_add("x_group", "MATCH (c:Customer)-[:FROM_NATION]->(n:Nation) RETURN n.n_name AS n_name, count(*) AS k, sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi",
     "select n_name, count(*) k, sum(c_acctbal) s, avg(c_acctbal) a, min(c_acctbal) lo, max(c_acctbal) hi from customer join nation on c_nationkey = n_nationkey group by 1", extended=True)
_add("x_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(DISTINCT n.n_name) AS names RETURN r.r_name AS r_name, size(names) AS k, names[0] AS a", "select r_name, count(distinct n_name) k, min(n_name) a from nation join region on n_regionkey = r_regionkey group by 1", extended=True)
_add("x_percentile", "MATCH (c:Customer) RETURN percentileCont(c.c_acctbal, 0.25) AS a, percentileDisc(c.c_acctbal, 0.5) AS b", "select quantile_cont(c_acctbal, 0.25) a, quantile_disc(c_acctbal, 0.5) b from customer", extended=True)
_add("x_distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS s", "select distinct c_mktsegment s from customer", extended=True)
_add("x_order", "MATCH (c:Customer) RETURN c.c_name AS c_name, c.c_acctbal AS b ORDER BY b DESC SKIP 3 LIMIT 5", "select c_name, c_acctbal b from customer order by b desc limit 5 offset 3", extended=True)
_add("x_with", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS k WHERE k >= 15 MATCH (c)-[:FROM_NATION]->(n) RETURN n.n_name AS n_name, k", "select n_name, k from (select o_custkey, count(*) k from orders group by 1 having count(*) >= 15) join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey", extended=True)
_add("x_optional", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 AND c.c_mktsegment = 'BUILDING' RETURN c.c_custkey AS c, o.o_orderkey AS o",
     "select c_custkey c, o_orderkey o from customer left join orders on o_custkey = c_custkey and o_totalprice > 100000 and c_mktsegment = 'BUILDING'", extended=True)
_add("x_optional_all", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {o_orderstatus: 'F'}) RETURN c.c_custkey AS c, o.o_orderkey AS o",
     "select c_custkey c, o_orderkey o from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F'", extended=True)
_add("x_optional_two", "MATCH (c:Customer)-[:FROM_NATION]->(n) OPTIONAL MATCH (c)-[:PLACED]->(o)-[:CONTAINS]->(p:Part) WHERE p.p_size = 7 AND n.n_name = 'NATION_7' RETURN c.c_custkey AS c, p.p_partkey AS p",
     """select c_custkey c, p_partkey p from customer left join (select distinct o_custkey, o_orderkey, p_partkey from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size = 7) on o_custkey = c_custkey
     and c_nationkey in (select n_nationkey from nation where n_name = 'NATION_7')""", extended=True)  # fmt: skip
_add("x_exists", "MATCH (s:Supplier) WHERE EXISTS { MATCH (s)-[:FROM_NATION]->(n:Nation) WHERE n.n_nationkey < 5 } RETURN s.s_name AS s_name", "select s_name from supplier where s_nationkey < 5", extended=True)
_add("x_not_exists", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order) RETURN c.c_name AS c_name", "select c_name from customer where c_custkey not in (select o_custkey from orders)", extended=True)
_add("x_unwind", "UNWIND range(1, 5) AS i MATCH (n:Nation) WHERE n.n_nationkey = i RETURN i, n.n_name AS n_name", "select cast(n_nationkey as bigint) i, n_name from nation where n_nationkey between 1 and 5", extended=True)
_add("x_union", "MATCH (n:Nation) RETURN n.n_name AS x UNION MATCH (r:Region) RETURN r.r_name AS x", "select n_name x from nation union select r_name from region", extended=True)
_add("x_union_all", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.r_name AS x UNION ALL MATCH (r:Region) RETURN r.r_name AS x", "select r_name x from nation join region on n_regionkey = r_regionkey union all select r_name from region", extended=True)
_add("x_comprehension", "MATCH (p:Part) RETURN [w IN split(p.p_name, ' ') WHERE size(w) > 3 | toUpper(w)] AS ws", "select list_transform(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3), lambda w: upper(w)) ws from part", extended=True)
_add("x_varlen_all", "MATCH (c:Customer)-[:FROM_NATION|IN_REGION*1..2]->(x) RETURN c.c_custkey AS c, x.n_name AS n, x.r_name AS r",
     """select c_custkey c, n_name n, null as r from customer join nation on c_nationkey = n_nationkey
     union all select c_custkey, null, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""", extended=True)  # fmt: skip


def _cypher(text: str, params: dict, extended: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(opened(spark, sf_dir), extended).query(text, params)


def api_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = opened(spark, sf_dir)
    return g.out_degree("PLACED").select((F.col("id") - F.lit(g.base("Customer"))).alias("c_custkey"), F.col("degree").alias("n"))


def api_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = opened(spark, sf_dir)
    return g.in_degree("IN_REGION").select((F.col("id") - F.lit(g.base("Region"))).alias("r_regionkey"), F.col("degree").alias("n"))


def api_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).all_nodes().groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n"))


def api_edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).neighbors().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def api_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = opened(spark, sf_dir)
    return g.neighbors(g.base("Customer") + 7, "PLACED").select((F.col("dst") - F.lit(g.base("Order"))).alias("o_orderkey"))


def api_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = opened(spark, sf_dir)
    return g.incoming_neighbors(g.base("Nation") + 3, "FROM_NATION").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def api_property_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir).nodes_with_label_and_property("Customer", "c_mktsegment", "BUILDING").select("c_name")


def ring_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_graph(spark, 100_000, 5).out_degree("NEXT").groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def ring_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ring_graph(spark, 100_000, 5)
    return Session(g, extended=True).query("MATCH (a:Item)-[:NEXT]->(b)-[:NEXT]->(c) RETURN count(*) AS n")


def write_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, change and delete in a stored graph, then read it back."""
    from .sources.store import scratch_store

    store = scratch_store(spark)
    regions = [r["r_name"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]
    with store.begin() as t:
        for i, name in enumerate(regions):
            t.run("CREATE (:Place {name: $n, size: $s})-[:NEAR {d: $s}]->(:Spot {of: $n})", {"n": name, "s": i})
        t.commit()
    with store.begin() as t:
        t.run("MATCH (p:Place) WHERE p.size > 1 SET p.size = p.size * 10, p.big = true")
        t.run("MATCH (p:Place {name: 'ASIA'}) DETACH DELETE p")
        t.commit()
    return Session(store.graph()).query("MATCH (p:Place)-[r:NEAR]->(s:Spot) RETURN p.name AS name, p.size AS size, p.big AS big, r.d AS d, s.of AS place")


OTHERS: dict[str, tuple[Callable, str]] = {
    "api_out_degree": (api_out_degree, "select o_custkey as c_custkey, count(*) n from orders group by 1"),
    "api_in_degree": (api_in_degree, "select n_regionkey as r_regionkey, count(*) n from nation group by 1"),
    "api_node_count": (api_node_count, """select 'Region' as label, count(*) n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer union all select 'Supplier', count(*) from supplier
        union all select 'Part', count(*) from part union all select 'Order', count(*) from orders union all select 'User', count(distinct user_id) from events union all select 'Event', count(*) from events"""),
    "api_edge_count": (api_edge_count, """select 'IN_REGION' as type, count(*) n from nation union all select 'FROM_NATION', (select count(*) from customer) + (select count(*) from supplier) union all select 'PLACED', count(*) from orders
        union all select 'EMITTED', count(*) from events union all select 'CONTAINS', count(*) from (select distinct l_orderkey, l_partkey from lineitem) union all select 'SUPPLIED_BY', count(*) from (select distinct l_orderkey, l_suppkey from lineitem)"""),
    "api_neighbors": (api_neighbors, "select o_orderkey from orders where o_custkey = 7"),
    "api_incoming": (api_incoming, "select 'FROM_NATION' as type, (select count(*) from customer where c_nationkey = 3) + (select count(*) from supplier where s_nationkey = 3) as n"),
    "api_property_lookup": (api_property_lookup, "select c_name from customer where c_mktsegment = 'BUILDING'"),
    "bench_one_hop": (ring_one_hop, "select cast(5 as bigint) degree, cast(100000 as bigint) n"),
    "bench_two_hop": (ring_two_hop, "select cast(2500000 as bigint) n"),
    "write_then_match": (write_then_match, """select r_name as name, case when k > 1 then k * 10 else k end as size, case when k > 1 then true end as big, k as d, r_name as place
        from (select r_name, row_number() over (order by r_regionkey) - 1 as k from region) where r_name <> 'ASIA'"""),
}

OTHERS |= stored_queries.OTHERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _cypher(text, params, extended) for k, (text, _, params, extended) in CYPHER.items()} | {k: f for k, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {k: v[1] for k, v in CYPHER.items()} | {k: sql for k, (_, sql) in OTHERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hop3"](spark, sf_dir)
