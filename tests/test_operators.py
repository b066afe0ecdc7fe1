import pytest
from pyspark.sql import functions as F

from larkspur.functions import strings as S
from larkspur.operators import graph as G
from larkspur.operators import keyed as K
from larkspur.operators import search as T
from larkspur.operators import temporal as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strings(spark):
    hello = F.lit("Hello World")
    assert one(spark, S.get_range(hello, -5, -1)) == "World"
    assert one(spark, S.get_range(hello, 5, 3)) == ""
    assert one(spark, S.set_range(F.lit("ab"), 4, "x")) == "ab\0\0x"
    assert one(spark, S.incr_by(F.lit("9223372036854775807"), 1)) is None
    assert one(spark, S.incr_by(F.lit("41"), 1)) == 42
    assert one(spark, S.bit_count(F.lit("foobar"))) == 26
    assert one(spark, S.get_bit(F.lit("a"), 1)) == 1 and one(spark, S.get_bit(F.lit("a"), 99)) == 0
    assert one(spark, S.matches(F.lit("h[llo"), "h\\[l?o"))


def test_geo(spark):
    lon, lat = F.lit(13.361389), F.lit(38.115556)
    assert one(spark, S.geo_score(lon, lat)) == 3479099956230698
    assert one(spark, S.geohash(lon, lat)) == "sqc8b49rny0"
    assert abs(one(spark, S.haversine(lon, lat, F.lit(15.087269), F.lit(37.502669))) - 166274.15) < 1


def test_lists(spark):
    x = F.array(*[F.lit(c) for c in "abcab"])
    assert one(spark, K.list_range(x, -3, -2)) == ["c", "a"]
    assert one(spark, K.list_remove(x, F.lit("a"), -1)) == ["a", "b", "c", "b"]
    assert one(spark, K.list_positions(x, F.lit("b"), -1, 1)) == [4]
    assert one(spark, K.list_insert(x, F.lit("c"), F.lit("z"))) == ["a", "b", "z", "c", "a", "b"]


def test_zadd_flags(spark):
    t = spark.createDataFrame([("k", "a", 1.0)], "key string, member string, score double")
    c = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 2.0)], "key string, member string, score double")
    got = lambda **f: {r.member: r.score for r in K.zadd(t, c, **f).collect()}
    assert got() == {"a": 0.5, "b": 2.0}
    assert got(nx=True) == {"a": 1.0, "b": 2.0}
    assert got(xx=True) == {"a": 0.5}
    assert got(gt=True) == {"a": 1.0, "b": 2.0}
    assert got(incr=True) == {"a": 1.5, "b": 2.0}


def test_query_language(spark):
    d = spark.createDataFrame([(1, "quick brown fox", "open,new", 5.0), (2, "lazy dog", "closed", 9.0), (3, "quick dog", "NEW", None)], "doc_id int, body string, tag string, n double")
    ids = lambda q: [r.doc_id for r in d.where(T.condition(T.parse(q), ["body"])).orderBy("doc_id").collect()]
    assert ids("quick") == [1, 3] and ids("quick dog") == [3] and ids("fox | lazy") == [1, 2]
    assert ids("@tag:{new}") == [1, 3] and ids("@n:[(5 +inf]") == [2] and ids("qui*") == [1, 3] and ids("%doh%") == [2, 3]
    with pytest.raises(ValueError):
        T.parse("(quick")


def test_graph_and_time(spark):
    e = spark.createDataFrame([(1, 2, "T", 1.0), (2, 3, "T", 1.0), (1, 3, "T", 5.0)], "src long, dst long, type string, weight double")
    start = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.hops) for r in G.neighbors(e, start, 2).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {r.id: r.cost for r in G.shortest(e, start, 2).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    n = spark.createDataFrame([(1, 1, 5), (2, 6, None), (3, None, 4)], "id long, valid_from long, valid_to long")
    assert [sorted(r.id for r in G.visible(n, t).collect()) for t in (4, 5, 6)] == [[1, 3], [1], [2]]
    v = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b")], "key string, valid_from long, value string")
    assert P.as_of(v, 4, ["key"]).first().value == "a"
    left = spark.createDataFrame([("k", 3), ("k", 5), ("z", 1)], "key string, t long")
    assert {(r.key, r.t): r.value for r in P.as_of_join(left, v, ["key"], "t", "valid_from", "value").collect()} == {("k", 3): "a", ("k", 5): "b", ("z", 1): None}


def test_every_query_has_a_frame(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["doc_id", "score"]
