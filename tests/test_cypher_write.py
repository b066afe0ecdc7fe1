import pytest

from larkspur.operators.cypher import CypherError, cypher, explain
from larkspur.operators.cypher_write import execute

NODES = [(1, ["P"], ("ann", 30)), (2, ["P"], ("bob", 25)), (3, ["C"], ("oslo", None))]
EDGES = [(1, 2, "KNOWS", 1.0), (1, 2, "KNOWS", 4.0), (1, 3, "IN", 1.0), (2, 3, "IN", 1.0)]


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(NODES, "id long, labels array<string>, props struct<name:string,age:int>")
    return n, spark.createDataFrame(EDGES, "src long, dst long, type string, weight double")


def after(graph, text, **params):
    nodes, edges = execute(text, *graph, params)
    assert nodes.columns == graph[0].columns and edges.columns == graph[1].columns
    return sorted((r.id, tuple(r.labels), tuple(r.props)) for r in nodes.collect()), sorted(tuple(r) for r in edges.collect())


PLAIN = [(i, tuple(x), p) for i, x, p in NODES]


def test_create(graph):
    n, e = after(graph, "CREATE (x:P {name: $who, age: 7})-[:KNOWS {weight: 2.5}]->(y:P {name: 'eve'})", who="dan")
    (x, y) = [r for r in n if r not in PLAIN]
    assert sorted(r[1:] for r in (x, y)) == [(("P",), ("dan", 7)), (("P",), ("eve", None))] and min(x[0], y[0]) > 3 and x[0] != y[0]
    dan, eve = (x[0], y[0]) if x[2][0] == "dan" else (y[0], x[0])
    assert [r for r in e if r not in EDGES] == [(dan, eve, "KNOWS", 2.5)]
    n, e = after(graph, "MATCH (a:P), (c:C) CREATE (a)<-[:HOLDS]-(c), (a)-[:SELF]->(a)")
    assert n == PLAIN and sorted(set(e) - set(EDGES)) == [(3, 1, "HOLDS", 1.0), (3, 2, "HOLDS", 1.0)]
    n, _ = after(graph, "MATCH (a:P) CREATE (b:Copy {name: a.name})")
    assert sorted(r[2][0] for r in n if r[1] == ("Copy",)) == ["ann", "bob"] and len({r[0] for r in n}) == 5


def test_merge(graph):
    n, e = after(graph, "UNWIND ['ann', 'dan', 'dan', null] AS w MERGE (p:P {name: w}) SET p.age = 1")
    assert [r for r in n if r[0] <= 3] == [(1, ("P",), ("ann", 1)), *PLAIN[1:]] and [r[1:] for r in n if r[0] > 3] == [(("P",), ("dan", 1))] and e == sorted(EDGES)
    n, e = after(graph, "MATCH (a:P), (b:P) MERGE (a)-[:KNOWS]->(b)")
    assert n == PLAIN and sorted(e) == sorted([*EDGES, (2, 1, "KNOWS", 1.0)])
    assert after(graph, "MERGE (c:C)")[0] == PLAIN and len(after(graph, "MERGE (c:New)")[0]) == 4


def test_set_and_delete(graph):
    assert after(graph, "MATCH (a)-[:IN]->(c) SET c.name = a.name, c.age = 5")[0] == [*PLAIN[:2], (3, ("C",), ("bob", 5))]
    assert after(graph, "MATCH (a {name: 'ann'}) SET a.age = null")[0][0] == (1, ("P",), ("ann", None))
    assert after(graph, "MATCH (a {name: 'ann'}) DETACH DELETE a") == (PLAIN[1:], [(2, 3, "IN", 1.0)])
    assert after(graph, "MATCH (a)-[r:KNOWS]->(b) DELETE r") == (PLAIN, [(1, 3, "IN", 1.0), (2, 3, "IN", 1.0)])
    assert after(graph, "MATCH (a {name: 'nobody'}) DELETE a") == (PLAIN, sorted(EDGES))


def test_map_properties(spark, graph):
    n = spark.createDataFrame([(1, ["P"], {"a": "1", "b": "2"}), (2, ["P"], None)], "id long, labels array<string>, props map<string,string>")
    nodes, _ = execute("MATCH (p) SET p.a = null, p.c = id(p) CREATE (q:Q {z: 9})", n, graph[1])
    assert sorted(((r.labels, r.props) for r in nodes.collect()), key=str) == sorted([(["P"], {"b": "2", "c": "1"}), (["P"], {"c": "2"}), (["Q"], {"z": "9"}), (["Q"], {"z": "9"})], key=str)


def test_empty_graph(spark, graph):
    nodes, edges = execute("CREATE (x:P {name: 'first'})", graph[0].limit(0), graph[1].limit(0))
    assert [(r.id, r.props.name) for r in nodes.collect()] == [(1, "first")] and edges.isEmpty()


@pytest.mark.parametrize("text", ["MATCH (a) RETURN a", "CREATE (a)-[:T]-(b)", "CREATE (a {nosuch: 1})", "MATCH (a) CREATE (a:X)", "MERGE (a)-[:T]->(b)", "SET a.b = 1", "CREATE (a) MATCH (b)", "MATCH (a) DELETE b"])
def test_errors(graph, text):
    with pytest.raises(CypherError):
        execute(text, *graph)


def test_valid_at(spark):
    n = spark.createDataFrame([(1, ["P"], ("a",), 0, 10), (2, ["P"], ("b",), 5, None)], "id long, labels array<string>, props struct<name:string>, valid_from long, valid_to long")
    e = spark.createDataFrame([(1, 2, "T", 1.0, 6, 8)], "src long, dst long, type string, weight double, valid_from long, valid_to long")
    assert [cypher("MATCH (a) RETURN id(a) AS i ORDER BY i", n, e, valid_at=t).count() for t in (4, 5, 11)] == [1, 2, 1]
    assert [cypher("MATCH (a)-->(b) RETURN id(b)", n, e, valid_at=t).count() for t in (5, 7, 9)] == [0, 1, 0]


def test_explain():
    assert explain("MATCH (a:P)-[:T*1..3]->(b) WHERE a.x = 1 RETURN b.y, count(*) ORDER BY b.y LIMIT 3") == ["NodeScan P", "Expand *1..3 T", "Filter", "Aggregate", "Sort", "Limit"]
