import pytest

from larkspur.operators.cypher import CypherError, cypher, parse

NODES = [(1, ["P"], ("ann", 30)), (2, ["P"], ("bob", 25)), (3, ["C"], ("oslo", None)), (4, ["P"], ("cid", 40)), (5, ["P"], ("dot", None))]
EDGES = [(1, 2, "KNOWS", 1.0), (1, 2, "KNOWS", 4.0), (2, 4, "KNOWS", 2.0), (4, 1, "KNOWS", 1.0), (1, 3, "IN", 1.0), (2, 3, "IN", 1.0)]


@pytest.fixture(scope="module")
def ask(spark):
    n = spark.createDataFrame(NODES, "id long, labels array<string>, props struct<name:string,age:int>").cache()
    e = spark.createDataFrame(EDGES, "src long, dst long, type string, weight double").cache()
    return lambda q, **p: [tuple(r) for r in cypher(q, n, e, p).collect()]


def test_match_and_where(ask):
    assert ask("MATCH (p:P) WHERE p.age > 26 RETURN p.name AS name ORDER BY name") == [("ann",), ("cid",)]
    assert ask("MATCH (a {name: $who})-[:KNOWS]->(b) RETURN b.name", who="ann") == [("bob",)]
    assert ask("MATCH (a)<-[r:KNOWS]-(b) WHERE a.name = 'bob' RETURN b.name, r.weight") == [("ann", 1.0)]
    assert sorted(ask("MATCH (a:P)-[:IN]->(c:C)<-[:IN]-(b:P) WHERE a.name < b.name RETURN a.name, b.name, c.name")) == [("ann", "bob", "oslo")]
    assert ask("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c)-[:KNOWS]->(a) WHERE id(a) = 1 RETURN c.name") == [("cid",)]


def test_variable_length(ask):
    assert ask("MATCH (a {name:'ann'})-[:KNOWS*1..2]->(b) RETURN b.name AS n ORDER BY n DESC") == [("cid",), ("bob",)]
    assert ask("MATCH (a {name:'ann'})-[:KNOWS*2]->(b) RETURN b.name") == [("cid",)]
    assert len(ask("MATCH (a {name:'ann'})-[*0..1]-(b) RETURN id(b)")) == 4


def test_optional_aggregates_and_with(ask):
    got = ask("MATCH (p:P) OPTIONAL MATCH (p)-[:KNOWS]->(q:P) RETURN p.name AS n, count(q) AS c ORDER BY c DESC, n")
    assert got == [("ann", 1), ("bob", 1), ("cid", 1), ("dot", 0)]
    assert ask("MATCH (p:P)-[:IN]->(c) WITH c, count(*) AS n WHERE n > 1 RETURN c.name, n") == [("oslo", 2)]
    assert ask("MATCH (p:P) RETURN p.age AS a ORDER BY a SKIP 1 LIMIT 2") == [(25,), (30,)]
    assert ask("UNWIND [3, 1, 3] AS x RETURN DISTINCT x ORDER BY x") == [(1,), (3,)]


def test_expressions(ask):
    assert ask("RETURN 7 / 2 AS a, 7 % 0 AS b, 1 / 0 AS c, 7.0 / 2 AS d, 'a' + 'b' AS e") == [(3, None, None, 3.5, "ab")]
    assert ask("RETURN null = null AS a, 1 = 'x' AS b, 1 < 'x' AS c, true OR null AS d, 2 IN [1, 2] AS e, -3 + 1 AS f") == [(True, False, None, None, True, -2)]
    assert ask("RETURN 'abc' =~ '.*b.*' AS a, 'abc' =~ 'a.c' AS b, size('é') AS c, toInteger('x') AS d, nosuch(1) AS e, coalesce(null, 2) AS f") == [(True, False, 2, None, None, 2)]


def test_text_of_a_map(spark):
    n = spark.createDataFrame([(1, ["P"], {"age": "30"}), (2, ["P"], {"age": "4"})], "id long, labels array<string>, props map<string,string>")
    e = spark.createDataFrame([(1, 2, "T", 1.0)], "src long, dst long, type string, weight double")
    assert [tuple(r) for r in cypher("MATCH (p) WHERE p.age > 5 OPTIONAL MATCH (p)-->(q) RETURN id(p), q.age", n, e).collect()] == [(1, "4")]


@pytest.mark.parametrize("text", ["MATCH (a) RETURN", "MATCH (a", "RETURN *", "MATCH (a)-[r*1..2]->(b) RETURN b", "MATCH (a)", "RETURN 1 MATCH (a)", "RETURN §"])
def test_errors(text):
    with pytest.raises(CypherError):
        parse(text)
