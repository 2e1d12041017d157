"""Parsing, static rules and value rules."""

import math

import pytest

from lodegraph.cypher import ast as A
from lodegraph.cypher.naming import column_name
from lodegraph.cypher.parser import parse
from lodegraph.errors import QuerySyntaxError
from lodegraph.session import Session
from lodegraph.sources.catalog import Graph


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame([(0, "Ann", 30, 1.5), (1, "Bob", None, float("nan")), (2, None, 20, None)], "k long, name string, age long, w double")
    g = Graph(spark).add_nodes("Person", people, "k", ["name", "age", "w"])
    g = g.add_nodes(("City", "Place"), spark.createDataFrame([(0, "Rome")], "k long, name string"), "k", ["name"])
    knows = spark.createDataFrame([(0, 1, 5), (1, 2, 6), (2, 0, 7), (0, 0, 8)], "a long, b long, since long")
    g = g.add_rels("KNOWS", knows, ("Person", "a"), ("Person", "b"), {"since": knows["since"]})
    return g.add_rels("LIVES", spark.createDataFrame([(0, 0), (1, 0)], "a long, b long"), ("Person", "a"), ("City", "b"))


def value(graph, text, **params):
    return Session(graph, extended=True).query(f"RETURN {text} AS x", params).collect()[0]["x"]


def rows(graph, text, extended=False, **params):
    return sorted((tuple(r) for r in Session(graph, extended).query(text, params).collect()), key=repr)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1 = 1.0", True), ("1 = 'a'", False), ("null = 1", None), ("'a' < 1", None), ("[1,null] = [1,null]", None), ("[1] = [1,2]", False), ("[1,2] < [1,3]", True), ("[1] < [1,0]", True),
        ("[null] < [1]", None), ("null IN []", False), ("2 IN [1,null]", None), ("1 IN [1,null]", True), ("7/2", 3), ("-7/2", -3), ("7/0", None), ("7%0", None), ("-7%3", -1),
        ("7.0/0", math.inf), ("-7.0/0", -math.inf), ("2^3^2", 64.0), ("'a'+'b'", "ab"), ("'a'+1", None), ("[1]+2", [1, 2]), ("0+[1]", [0, 1]), ("[1]+[2]", [1, 2]),
        ("9223372036854775807+1", 9223372036854775808.0), ("-9223372036854775808", -9223372036854775808), ("0x1F", 31), ("0o17", 15), (".5", 0.5), ("1e3", 1000.0),
        ("'it''s'", "it's"), (r"'a\nb'", "a\nb"), (r"'é'", "é"), ("true XOR null", None), ("NOT null", None), ("1 < 2 < 3", True), ("1 + 1 IS NULL", False),
        ("CASE WHEN null THEN 1 WHEN true THEN 2 END", 2), ("CASE 3 WHEN 1 THEN 'a' END", None), ("[1,2,3][-1]", 3), ("[1,2,3][9]", None), ("[1,2,3][0..2]", [1, 2]), ("[1,2,3][-2..]", [2, 3]), ("[1,2,3][..null]", None),
        ("{a:1, b:'x'}.b", "x"), ("{a:1}.z", None), ("any(x IN [1,null] WHERE x > 5)", None), ("all(x IN [] WHERE false)", True), ("single(x IN [1,1] WHERE x = 1)", False), ("reduce(s=0, x IN [1,2,3] | s+x)", 6),
        ("reduce(s=0, x IN [1.5] | s+x)", 1.5), ("size('ñandú')", 5), ("trim(' x ')", "x"), ("split('a.b','.')", ["a", "b"]), ("split('ab','')", ["", "a", "b", ""]), ("replace('ab','','-')", "-a-b-"), ("substring('abc',-1)", ""),
        ("left('abc',0)", ""), ("reverse([1,2])", [2, 1]), ("toString(1.0)", "1"), ("toString(1.5)", "1.5"), ("toInteger('1.9')", 1), ("toInteger(' 1')", None), ("toInteger('x')", None), ("toFloat('1e400')", None), ("toBoolean('TRUE')", True),
        ("round(-2.5)", -3.0), ("sign(-2)", -1), ("ceil(1.2)", 2.0), ("sqrt(-1) = sqrt(-1)", False), ("log(2,8)", 3.0), ("log(-1)", None), ("range(1,5,2)", [1, 3, 5]), ("range(5,1)", []), ("range(5,1,-2)", [5, 3, 1]), ("range(1,2,0)", None),
        ("head([])", None), ("tail([])", []), ("coalesce(null,2)", 2), ("keys({b:1,a:2})", ["a", "b"]), ("rand()", 0.42), ("[x IN [1,2,3] WHERE x > 1 | x * 2]", [4, 6]), ("$p", 7), ("$missing", None),
        ("date('2020-02-29') + duration('P1Y')", "2021-02-28"), ("date('2020-02-30')", None), ("date.truncate('week', date('2020-01-01'))", "2019-12-30"), ("date.truncate('century', date('1999-01-01'))", "1900-01-01"),
        ("date.truncate('month', date('2020-05-17'), {day: 3})", "2020-05-03"), ("duration.between(date('2021-03-01'), date('2020-01-31'))", "P-1Y-1M-1D"), ("duration('P1M') + duration('P2D')", "P1M2D"), ("duration('P1D') * 1.5", "P1DT12H"),
        ("duration.inSeconds(time('10:00'), time('11:30'))", "PT1H30M"), ("localtime('10:00') + duration('PT15H')", "01:00"), ("datetime('2020-01-01T10:00+02:00').epochSeconds", 1577865600), ("date('2020-01-01') < date('2020-01-02')", True),
        ("datetime('2020-01-01T10:00+02:00') = datetime('2020-01-01T08:00Z')", True), ("duration({months: 14}).monthsOfYear", 2), ("localdatetime('2020-01-01T10:11:12.25').millisecond", 250), ("time('10:00-03:30').offsetMinutes", -210),
        ("datetime({datetime: datetime('2020-01-01T10:00Z'), timezone: '+02:00'})", "2020-01-01T12:00+02:00"), ("date()", "1970-01-01"), ("duration('PT-0.5S')", "PT-0.5S"),
    ],
)
def test_values(graph, text, expected):
    assert value(graph, text, p=7) == expected


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("MERGE (n) RETURN n", "MERGE is outside"), ("MATCH (n) RETURN DISTINCT n", "DISTINCT is outside"), ("MATCH (n) RETURN n ORDER BY n.x", "ORDER BY is outside"), ("MATCH (n) WITH n RETURN n", "WITH is outside"),
        ("UNWIND [1] AS x RETURN x", "UNWIND is outside"), ("OPTIONAL MATCH (n) RETURN n", "OPTIONAL MATCH is outside"), ("MATCH p = (a)-->(b) RETURN p", "named paths is outside"), ("MATCH (a)-[*1..2]->(b) RETURN a", "variable-length"),
        ("MATCH (n) RETURN count(*)", "aggregation is outside"), ("RETURN 1 UNION RETURN 2", "UNION is outside"), ("MATCH (n) SET n:X", "SET of a label is outside"), ("MATCH (n) RETURN m", "UndefinedVariable (m)"), ("RETURN foo(1)", "UnknownFunction (foo)"),
        ("MATCH (n) RETURN n.a AS x, n.b AS x", "ColumnNameConflict"), ("RETURN *", "NoVariablesInScope"), ("MATCH (n) RETURN n LIMIT -1", "NegativeIntegerArgument"), ("MATCH (n) RETURN n LIMIT n.x", "NonConstantExpression"), ("RETURN NOT 1", "InvalidArgumentType"),
        ("RETURN 1 AND true", "InvalidArgumentType"), ("RETURN 1 IN 2", "InvalidArgumentType"), ("MATCH (n) WHERE n RETURN n", "InvalidArgumentType"), ("MATCH (a)-[a]->(b) RETURN a", "VariableTypeConflict"), ("RETURN 9223372036854775808", "IntegerOverflow"),
        ("WHERE true RETURN 1", "WHERE cannot be the first"), ("RETURN 1 )", "unexpected"), ("MATCH (a)-[r]->(b) RETURN labels(r)", "InvalidArgumentType"), ("MATCH (a) RETURN type(a)", "InvalidArgumentType"), ("MATCH (a)", "must end with RETURN"), ("", "empty query"),
        ("MATCH shortestPath((a)-->(b)) RETURN a", "shortestPath is outside"), ("RETURN range(1, 2000000)", "NumberOutOfRange"), ("RETURN [x IN [1] WHERE x > 0]", "list comprehension is outside"), ("CALL db.x()", "CALL is outside"),
    ],
)
def test_refusals(graph, text, message):
    with pytest.raises(QuerySyntaxError, match=None) as e:
        Session(graph).query(text)
    assert message in str(e.value)


def test_nan_is_neither_equal_nor_ordered(graph):
    assert rows(graph, "MATCH (n:Person) RETURN n.name, n.w = n.w, n.w > 0") == [("Ann", True, True), ("Bob", False, False), (None, None, None)]


def test_patterns_by_hand(graph):
    assert rows(graph, "MATCH (a:Person)-[r:KNOWS]->(b) RETURN a.name, r.since, b.name") == [("Ann", 5, "Bob"), ("Ann", 8, "Ann"), ("Bob", 6, None), (None, 7, "Ann")]
    assert rows(graph, "MATCH (a)-[:KNOWS]->(a) RETURN a.name") == [("Ann",)]
    assert rows(graph, "MATCH (a:Person {name: 'Ann'})-[r:KNOWS]-(b) RETURN r.since") == [(5,), (7,), (8,)]
    assert rows(graph, "MATCH (a:Person {name: 'Ann'})<-[:KNOWS {since: 7}]-(b) RETURN b.age") == [(20,)]
    assert rows(graph, "MATCH (c:Place)<-[:LIVES]-(p) RETURN labels(c), p.name") == [(["City", "Place"], "Ann"), (["City", "Place"], "Bob")]
    assert rows(graph, "MATCH (p:Person)-[:KNOWS|LIVES]->(x) WHERE p.name = 'Bob' RETURN labels(x)[0]") == [("City",), ("Person",)]


def test_a_relationship_is_taken_once_in_a_pattern(graph):
    edges = [(0, 1), (1, 2), (2, 0), (0, 0)]
    want = sorted(((a[0], a[1], b[1]) for a in edges for b in edges if a[1] == b[0] and a != b), key=repr)
    key = {"Ann": 0, "Bob": 1, None: 2}
    got = rows(graph, "MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name, b.name, c.name")
    assert sorted(tuple(key[x] for x in r) for r in got) == want


def test_names_of_columns():
    names = lambda q: [column_name(i.expr, k) for k, i in enumerate(parse(q, True).clauses[-1].items)]
    assert names("RETURN a.b, toUpper(a.b), (1 + 2) * 3, [1, 'x'], a[0], $p, NOT a.b, a IS NULL, CASE WHEN true THEN 1 END") == [
        "a.b", "toupper(a.b)", "(1 + 2) * 3", "[1, 'x']", "a[0]", "$p", "NOT a.b", "a IS NULL", "case(...)",
    ]


def test_parse_keeps_left_association():
    item = parse("RETURN 1 - 2 - 3").clauses[0].items[0].expr
    assert isinstance(item.left, A.Binary)
    assert item.right == A.Literal(3)


def test_limit_follows_scan_order(graph):
    assert [r[0] for r in Session(graph).query("MATCH (n:Person) RETURN n.age LIMIT 2").collect()] == [30, None]


def test_explain_tells_operators_and_plan(graph):
    text = Session(graph).explain("MATCH (a:Person)-[:LIVES]->(b) WHERE a.name = 'Ann' RETURN b.name")
    assert "NodeScan(a:Person)" in text
    assert "Physical Plan" in text


def test_typed_interface(graph):
    assert graph.node_count() == 4
    assert graph.node_count("Person") == 3
    assert graph.edge_count("KNOWS") == 4
    assert graph.labels() == ["City", "Person", "Place"]
    assert graph.node_properties(0)["name"] == "Ann"
    assert graph.edge_property(0, "KNOWS", 1, "since") == 5
    assert graph.nodes_with_label_and_property("Person", "age", 30.0).count() == 1
    assert graph.is_tombstoned(77)


@pytest.mark.parametrize("text", ["RETURN 1 AS x;", "RETURN 1 AS x; x", "RETURN 1 AS x; ¬ 'open", "RETURN 1 AS x ; RETURN 2 AS x"])
def test_text_after_a_statement_is_not_read(graph, text):
    assert rows(graph, text) == [(1,)]
