from pyspark.sql import functions as F

from larkspur.operators import graph as G
from larkspur.operators import keyed as K
from larkspur.operators import temporal as P
from larkspur.operators import vectors as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_graph_with_vectors(spark):
    n = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0, 0.0])], "id long, embedding array<double>")
    e = spark.createDataFrame([(1, 2, "T", 1.0), (2, 3, "T", 1.0), (1, 4, "T", 1.0)], "src long, dst long, type string, weight double")
    start = spark.createDataFrame([(1,)], "id long")
    assert rows(G.hybrid_expand(n, e, [1, 0], 1, 1)) == [(1, 0), (2, 1), (4, 1)]
    got = {r.id: round(r.score, 4) for r in G.hybrid_rerank(n, e, start, n, [1, 0], 9).collect()}
    assert got == {1: 1.0, 2: 0.25, 3: round(0.5 * 0.5**0.5 + 0.5 / 3, 4), 4: 0.25, 5: 0.6}
    assert [(r.id, r.step) for r in G.hybrid_walk(n, e, start, [0, 1], 2, beam=1).orderBy("step").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert rows(G.hybrid_walk(n, e, start, [0, 1], 2, beam=1, least=0.9).select("id")) == [(1,), (2,)]
    assert G.add_edges(e, spark.createDataFrame([(7, 7), (7, 8)], "src long, dst long")).count() == 4
    cost = spark.range(1).select(G.edge_cost(F.lit(-2.0), F.lit(1000), 3000, 0.5), G.edge_cost(F.lit(2.0), F.lit(0), 3000, 0.5)).first()
    assert tuple(cost) == (3.0, 2.0)


def test_cache_and_session(spark):
    v = spark.createDataFrame([(1, "c:1", [0.0, 0.0]), (2, "c:2", [3.0, 0.0]), (3, "d:1", [1.0, 0.0])], "vec_id long, key string, embedding array<double>")
    ids = lambda limit: [(r.vec_id, r.cached) for r in V.cache_search(v, [1.0, 0.0], limit, 2, prefix="c:").collect()]
    assert ids(1.5) == [(1, True)] and ids(0.5) == [(3, False), (1, False)]
    assert rows(V.unseen(v.select("vec_id"), v.where("vec_id = 2"), "vec_id")) == [(1,), (3,)]


def test_all_or_nothing(spark):
    t = spark.createDataFrame([("a", 1, 7), ("b", 2, 8)], "key string, value int, version int")
    new = spark.createDataFrame([("c", 3, 9)], t.schema)
    both = new.unionByName(t.where("key = 'a'"))
    assert K.set_all_or_none(t, new, ["key"]).count() == 3 and rows(K.set_all_or_none(t, both, ["key"])) == rows(t)
    seen = lambda *w: spark.createDataFrame(w, "key string, version int")
    assert K.commit(t, new, seen(("a", 7), ("z", None)), ["key"]).count() == 3
    assert rows(K.commit(t, new, seen(("a", 6)), ["key"])) == rows(t) and rows(K.commit(t, new, seen(("b", None)), ["key"])) == rows(t)
    assert rows(K.copy(t, "a", "b").select("key", "value")) == [("a", 1), ("b", 2)]
    assert rows(K.copy(t, "a", "b", replace=True).select("key", "value")) == [("a", 1), ("b", 1)]
    assert rows(K.copy(t, "z", "b", replace=True)) == rows(t)
    s = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x")], "key string, member string")
    assert rows(K.move_member(s, "p", "q", "x")) == [("p", "y"), ("q", "x")] and rows(K.move_member(s, "q", "p", "z")) == rows(s)
    z = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0), ("k", "c", 2.0)], "key string, member string, score double")
    taken, left = K.zpop(z, 1, highest=True)
    assert [r.member for r in taken.collect()] == ["c"] and left.count() == 2


def test_streams(spark):
    s = spark.createDataFrame([("k", 5, 0), ("k", 5, 1)], "key string, id_ms long, id_seq long")
    new = spark.createDataFrame([("k", 5, 2), ("k", 5, 1), ("k", 6, 3), ("j", 5, 4)], "key string, id_ms long, ord int")
    all = P.append(s, new)
    assert rows(all) == [("j", 5, 0), ("k", 5, 0), ("k", 5, 1), ("k", 5, 2), ("k", 5, 3), ("k", 6, 0)]
    groups = spark.createDataFrame([("k", "g", 5, 2)], "key string, group string, last_ms long, last_seq long")
    assert rows(P.read_group(all, groups).select("id_ms", "id_seq")) == [(5, 3), (6, 0)]
    assert {r.key: (r.length, tuple(r.last)) for r in P.stream_info(all).collect()} == {"j": (1, (5, 0)), "k": (5, (6, 0))}
