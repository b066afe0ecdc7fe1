from larkspur.operators import graph as G
from larkspur.operators.cypher import cypher


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some_edges(spark):
    return spark.createDataFrame([(1, 2, "T", 5.0), (1, 2, "T", 3.0), (2, 3, "T", 1.0), (1, 3, "T", 9.0), (3, 4, "T", None), (3, 4, "T", 2.0), (4, 5, "U", 1.0)], "src long, dst long, type string, weight double")


def test_costs_without_paths(spark):
    """Rounds read the edges as written, without grouping them, and costs carry no paths; an edge without weight is no cheaper."""
    e, start = some_edges(spark), spark.createDataFrame([(1,)], "id long")
    got = G.shortest(e, start, 3)
    assert {tuple(r) for r in got.collect()} == {(1, 0.0), (2, 3.0), (3, 4.0), (4, 6.0), (5, 12.0)}
    assert "path#" not in plan(got) and "Aggregate [a#" not in plan(got) and "LogicalRDD" not in plan(got)
    assert {(r.id, r.cost, tuple(r.path)) for r in G.shortest_paths(e, start, 3).collect()} == {(1, 0.0, (1,)), (2, 3.0, (1, 2)), (3, 4.0, (1, 2, 3)), (4, 6.0, (1, 2, 3, 4)), (5, 12.0, (1, 3, 4, 5))}
    back = G.shortest(e, spark.createDataFrame([(3,)], "id long"), 2, "IN")
    assert {tuple(r) for r in back.collect()} == {(3, 0.0), (2, 1.0), (1, 4.0)}


def test_only_what_is_reached_is_made_distinct(spark):
    n = spark.createDataFrame([(i, ["N"], ("n",)) for i in range(1, 6)], "id long, labels array<string>, props struct<name string>")
    got = cypher("MATCH (a)-[:T*1..2]-(b) WHERE id(a) = 1 RETURN id(b) AS id", n, some_edges(spark))
    assert sorted(r.id for r in got.collect()) == [2, 3, 4]
    assert "Aggregate [src#" not in plan(got) and "Aggregate [dst#" not in plan(got)
    by = cypher("MATCH (a)-[:T*1..3 {weight: 1.0}]-(b) WHERE id(a) = 2 RETURN id(b) AS id", n, some_edges(spark))
    assert [r.id for r in by.collect()] == [3]
