"""Further registered queries: lists, hashes, sets, keyspace, streams, queues, versions and searches in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import collections as C
from ..operators import graph as G
from ..operators import index as I
from ..operators import ivf as A
from ..operators import keyed as K
from ..operators import search as T
from ..operators import temporal as P
from ..operators import vectors as V
from ..operators.cypher import cypher
from ..operators.cypher_write import execute
from ..sources.tables import scratch, spread, table
from .queries import EDGES, L2, WORDS, ZSETS, edges, nodes, places, query, sets, zsets

# ---- strings


@query("SELECT c_custkey, CASE WHEN strlen(t) > 3 THEN decode(array_to_string(list_transform(range(3, least(6, strlen(t)) + 1), lambda i: '\\x' || lower(substr(hex(encode(t)), 2 * i + 1, 2))), '')::BLOB) ELSE '' END AS part FROM (SELECT c_custkey, 'aé' || c_name AS t FROM customer)")
def string_getrange_bytes(spark, d):
    t = F.concat(F.lit("aé"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.get_range(t, 3, 6).alias("part"))


@query("SELECT c_custkey, 'aéXY' || substr(c_name, 3) AS changed FROM customer")
def string_setrange_bytes(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.set_range(F.concat(F.lit("aé"), F.col("c_name")), 3, "XY").alias("changed"))


@query("SELECT user_id, event_id, round(sum(CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS value FROM events")
def string_incrbyfloat(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 10 == 0, F.lit("nan")).otherwise(F.col("value").cast("string")).alias("delta"))
    return K.running_float(log, ["user_id"], "event_id", "delta").select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("SELECT user_id, event_id, CASE WHEN s <= 9223372036854775807 THEN s::BIGINT END AS value FROM (SELECT user_id, event_id, sum(event_id::HUGEINT * 30000000000000) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)")
def string_incrby_overflow(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id").cast("decimal(20,0)") * F.lit(30000000000000).cast("decimal(14,0)")).alias("delta"))
    return K.running(log, ["user_id"], "event_id", "delta").drop("delta")


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def string_append(spark, d):
    return K.appended(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("value")), ["user_id"], "event_id")


# ---- geo


@query("WITH g AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat FROM customer), m AS (SELECT id, 2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians(5.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(5.0)) * pow(sin((radians(179.0) - radians(lon)) / 2), 2))) AS m FROM g) SELECT id, round(m, 1) AS m FROM m WHERE m <= 2000000")
def geo_search_antimeridian(spark, d):
    m = S.haversine(F.col("lon"), F.col("lat"), F.lit(179.0), F.lit(5.0))
    near = S.in_bounds(F.col("lon"), F.col("lat"), S.bounds(179.0, 5.0, 2e6))
    return places(spark, d).where(near & (m <= 2e6)).select("id", F.round(m, 1).alias("m"))


HAV = "2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians({b}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({b})) * pow(sin((radians({a}) - radians(lon)) / 2), 2)))"


@query(f"WITH g AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat FROM customer) SELECT id FROM g WHERE {HAV.format(a='10.0', b='lat')} <= 2500000 AND {HAV.format(a='lon', b='20.0')} <= 1000000")
def geo_search_box(spark, d):
    return places(spark, d).where(S.in_rectangle(F.col("lon"), F.col("lat"), (10.0, 20.0), 5e6, 2e6)).select("id")


# ---- lists


def lists(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("value"))


FLAT = "l AS (SELECT o_custkey AS key, o_orderkey AS pos, o_orderstatus AS value FROM orders)"
ITEMS = "i AS (SELECT c_custkey AS key, n AS ord, 'N' || n AS value FROM customer, (SELECT unnest(range(0, 2)) AS n) WHERE c_custkey % 7 = 0)"


def items(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("n"))
    return c.select("key", F.col("n").alias("ord"), F.concat(F.lit("N"), F.col("n").cast("string")).alias("value"))


def in_order(rows):
    return rows.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), ",").alias("items"))


ORDERED = "SELECT key, string_agg(value, ',' ORDER BY a, b) AS items FROM u GROUP BY key"


@query(f"WITH {FLAT}, {ITEMS}, u AS (SELECT key, 0 AS a, pos AS b, value FROM l UNION ALL SELECT key, 1, ord, value FROM i) {ORDERED}")
def list_rpush(spark, d):
    return in_order(C.push(lists(spark, d), items(spark, d)))


@query(f"WITH {FLAT}, {ITEMS}, u AS (SELECT key, 0 AS a, pos AS b, value FROM l UNION ALL SELECT key, -1, -ord, value FROM i) {ORDERED}")
def list_lpush(spark, d):
    return in_order(C.push(lists(spark, d), items(spark, d), left=True))


@query(f"WITH {FLAT}, {ITEMS}, u AS (SELECT key, 0 AS a, pos AS b, value FROM l UNION ALL SELECT key, 1, ord, value FROM i WHERE key IN (SELECT key FROM l)) {ORDERED}")
def list_rpushx(spark, d):
    return in_order(C.push(lists(spark, d), items(spark, d), only_existing=True))


@query(f"WITH {FLAT}, {ITEMS}, u AS (SELECT key, 0 AS a, pos AS b, value FROM l UNION ALL SELECT key, -1, -ord, value FROM i WHERE key IN (SELECT key FROM l)) {ORDERED}")
def list_lpushx(spark, d):
    return in_order(C.push(lists(spark, d), items(spark, d), left=True, only_existing=True))


@query(f"WITH {FLAT} SELECT key, pos, value FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) <= 2")
def list_lpop(spark, d):
    return C.pop(lists(spark, d), 2)[0].select("key", "pos", "value")


@query(f"WITH {FLAT} SELECT key, pos, value FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) > 2")
def list_rpop_rest(spark, d):
    return C.pop(lists(spark, d), 2, left=False)[1].select("key", "pos", "value")


@query(f"WITH {FLAT} SELECT key, pos, CASE WHEN key = 4 AND n = 2 THEN 'SET' ELSE value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS n FROM l)")
def list_lset(spark, d):
    return C.set_at(lists(spark, d), 4, -2, "SET")


@query(f"WITH {FLAT}, e AS (SELECT * FROM l WHERE key = 4 ORDER BY pos DESC LIMIT 1), u AS (SELECT key, 0 AS a, pos AS b, value FROM l WHERE (key, pos) NOT IN (SELECT key, pos FROM e) UNION ALL SELECT 7, -1, 0, value FROM e) {ORDERED}")
def list_rpoplpush(spark, d):
    return in_order(C.move(lists(spark, d), 4, 7))


@query(f"WITH {FLAT}, e AS (SELECT * FROM l WHERE key = 4 ORDER BY pos LIMIT 1), u AS (SELECT key, 0 AS a, pos AS b, value FROM l WHERE (key, pos) NOT IN (SELECT key, pos FROM e) UNION ALL SELECT 7, 1, 0, value FROM e) {ORDERED}")
def list_lmove(spark, d):
    return in_order(C.move(lists(spark, d), 4, 7, from_left=True, to_left=False))


@query(f"WITH {FLAT} SELECT * FROM l WHERE key = 4 ORDER BY pos LIMIT 3")
def list_lmpop(spark, d):
    return C.multi_pop(lists(spark, d), [-5, 4, 7], 3)[0]


WAITING = "w AS (SELECT c_custkey % 50 AS key, c_custkey AS ord, c_name AS waiter FROM customer WHERE c_custkey % 3 = 0)"


def waiters(spark, d):
    return table(spark, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") % 50).alias("key"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("waiter"))


@query(f"WITH {FLAT}, {WAITING}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM w) SELECT b.key, b.ord, b.waiter, a.pos, a.value FROM a JOIN b ON a.key = b.key AND a.n = b.n")
def list_blpop(spark, d):
    return C.serve(lists(spark, d), waiters(spark, d))[0]


@query(f"WITH {FLAT}, {WAITING}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS n FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM w) SELECT b.key, b.ord, b.waiter, a.pos, a.value FROM a JOIN b ON a.key = b.key AND a.n = b.n")
def list_brpop(spark, d):
    return C.serve(lists(spark, d), waiters(spark, d), highest=True)[0]


@query("SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY o_orderkey) FILTER (WHERE NOT (o_orderstatus = 'F' AND n <= 2)), ',') AS rest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def list_lrem_head(spark, d):
    t = K.as_list(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    got = t.select("o_custkey", F.array_join(K.list_remove(F.col("items"), F.lit("F"), 2), ",").alias("rest"))
    return got.withColumn("rest", F.when(F.col("rest") != "", F.col("rest")))


@query("SELECT o_custkey, array_to_string(list(n ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), ',') AS places FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1")
def list_lpos(spark, d):
    t = K.as_list(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    got = t.select("o_custkey", F.array_join(K.list_positions(F.col("items"), F.lit("F"), 1, 0).cast("array<string>"), ",").alias("places"))
    return got.withColumn("places", F.when(F.col("places") != "", F.col("places")))


# ---- hashes, sets, sorted sets


def hashes(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("field")).agg(F.max("event_id").cast("string").alias("value"))


HASHES = "h AS (SELECT user_id AS key, event_type AS field, max(event_id)::VARCHAR AS value FROM events GROUP BY 1, 2)"


@query(f"WITH {HASHES} SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS all_pairs, string_agg(field, ',' ORDER BY field) AS fields, string_agg(value, ',' ORDER BY field) AS vals FROM h GROUP BY key")
def hash_hgetall(spark, d):
    g = C.get_all(hashes(spark, d))
    pairs = F.transform("fields", lambda f: F.concat(f, F.lit("="), F.element_at("map", f)))
    return g.select("key", F.array_join(pairs, ",").alias("all_pairs"), F.array_join("fields", ",").alias("fields"), F.array_join("values", ",").alias("vals"))


@query(f"WITH {HASHES} SELECT key, count(*) AS n FROM h GROUP BY key")
def hash_hlen(spark, d):
    return C.lengths(hashes(spark, d))


@query(f"WITH {HASHES} SELECT k.c_custkey AS key, f.field, h.key IS NOT NULL AS found FROM customer k, (SELECT unnest(['click', 'none']) AS field) f LEFT JOIN h ON h.key = k.c_custkey AND h.field = f.field")
def hash_hexists(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.explode(F.array(F.lit("click"), F.lit("none"))).alias("field"))
    return C.has(hashes(spark, d), wanted, ["key", "field"])


@query("SELECT user_id, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hash_hincrbyfloat(spark, d):
    log = table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").alias("delta"))
    return K.last_write(K.running_float(log, ["user_id", "event_type"], "event_id", "delta"), ["user_id", "event_type"], "event_id").withColumn("value", F.round("value", 4))


EXPIRING = "x AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id * 10 + 7 END AS due, event_id % 5 > 0 AS found FROM events)"


def expiring(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.when(e % 4 > 0, e * 10 + 7).alias("at"), (e % 5 > 0).alias("found"))


@query(f"WITH {EXPIRING} SELECT event_id, CASE WHEN NOT found THEN -2 WHEN due IS NULL THEN -1 ELSE due // 1000 END AS s, CASE WHEN NOT found THEN -2 WHEN due IS NULL THEN -1 ELSE due END AS ms FROM x")
def key_expiretime(spark, d):
    at, found = F.col("at"), F.col("found")
    return expiring(spark, d).select("event_id", K.expire_time(at, found).cast("long").alias("s"), K.expire_time(at, found, True).cast("long").alias("ms"))


@query(f"WITH {EXPIRING} SELECT event_id, CASE WHEN NOT found THEN -2 WHEN due IS NULL THEN -1 WHEN due < 2000 THEN 0 ELSE due - 2000 END AS ms FROM x")
def hash_hpttl(spark, d):
    return expiring(spark, d).select("event_id", K.field_ttl(F.col("at"), F.lit(2000), True, F.col("found")).cast("long").alias("ms"))


@query(f"WITH {EXPIRING} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE due END AS expire_at FROM x")
def key_persist(spark, d):
    t = expiring(spark, d).select("event_id", F.col("at").alias("expire_at"))
    return C.get_expire(t, t.where("event_id % 6 = 0"), ["event_id"], F.lit(None).cast("long"))[1].select("event_id", "expire_at")


@query(f"WITH {HASHES} SELECT key, field, value FROM h WHERE field = 'click'")
def hash_hgetdel(spark, d):
    h = hashes(spark, d)
    return C.taken(h, h.where("field = 'click'"), ["key", "field"])[0].select("key", "field", "value")


@query("SELECT o_orderstatus AS key, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def set_scard(spark, d):
    return C.lengths(sets(spark, d).distinct())


@query("SELECT 'F' AS key, c_custkey AS member, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS found FROM customer")
def set_smismember(spark, d):
    wanted = table(spark, d, "customer").select(F.lit("F").alias("key"), F.col("c_custkey").alias("member"))
    return C.has(sets(spark, d), wanted, ["key", "member"])


@query("SELECT DISTINCT CASE WHEN o_orderstatus = 'F' AND o_custkey = 4 THEN 'O' ELSE o_orderstatus END AS key, o_custkey AS member FROM orders")
def set_smove(spark, d):
    return K.move_member(sets(spark, d).distinct(), "F", "O", 4)


@query("SELECT key, count(*) AS n, 5::BIGINT AS draws FROM (SELECT DISTINCT o_orderstatus AS key, o_custkey AS member FROM orders) GROUP BY key")
def set_srandmember_repeats(spark, d):
    s = sets(spark, d).distinct()
    drawn = C.draws(s, 5, seed=3)
    known = drawn.join(s, ["key", "member"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("draws"))
    return C.lengths(s).join(known, "key")


@query(f"WITH {ZSETS} SELECT key, count(*) AS n FROM z GROUP BY key")
def zset_zcard(spark, d):
    return C.lengths(zsets(spark, d))


@query(f"WITH {ZSETS} SELECT key, member, CASE WHEN member % 2 = 0 THEN score + 1.5 ELSE score END AS score FROM z")
def zset_zincrby(spark, d):
    z = zsets(spark, d)
    return K.zadd(z, z.where("member % 2 = 0").withColumn("score", F.lit(1.5)), incr=True)


@query(f"WITH {ZSETS} SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) <= 2")
def zset_zpopmax(spark, d):
    return K.zpop(zsets(spark, d), 2, highest=True)[0]


@query(f"WITH {ZSETS} SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) > 2")
def zset_zpopmin_rest(spark, d):
    return K.zpop(zsets(spark, d), 2)[1]


@query(f"WITH {ZSETS} SELECT key, member, score FROM z WHERE key = 3 ORDER BY score, member LIMIT 4")
def zset_zmpop(spark, d):
    return C.multi_pop(zsets(spark, d), [-1, 3, 5], 4, order="score")[0]


@query(f"WITH {ZSETS} SELECT key, member, score FROM z WHERE key = 3 AND score > 10 AND score <= 40 ORDER BY score, member LIMIT 7 OFFSET 2")
def zset_zrangebyscore_limit(spark, d):
    return zsets(spark, d).where((F.col("key") == 3) & K.score_between("(10", "40")).orderBy("score", "member").offset(2).limit(7)


# ---- keyspace


def keys(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select((c % 3).cast("int").alias("db"), c.alias("key"), F.col("c_name").alias("value"), F.when(c % 4 == 0, c * 10).alias("expire_at"))


KEYS = "k AS (SELECT (c_custkey % 3)::INT AS db, c_custkey AS key, c_name AS value, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10 END AS expire_at FROM customer)"


@query(f"WITH {KEYS} SELECT db, key, 'string' AS type FROM k UNION ALL SELECT DISTINCT 0, l_suppkey, 'zset' FROM lineitem")
def key_type(spark, d):
    return C.keyspace({"string": keys(spark, d), "zset": zsets(spark, d).withColumn("db", F.lit(0))})


@query(f"WITH {KEYS} SELECT db, count(*) AS n FROM k WHERE expire_at IS NULL OR expire_at > 500 GROUP BY db")
def key_dbsize(spark, d):
    return C.db_size(keys(spark, d), F.lit(500))


@query(f"WITH {KEYS} SELECT count(*) AS n FROM k WHERE key IN (1, 2, 2000000000) OR key = 2")
def key_exists(spark, d):
    return K.exists(keys(spark, d), spark.createDataFrame([(1,), (2,), (2000000000,)], "key long"))


@query(f"WITH {KEYS} SELECT db, CASE WHEN key = 5 THEN 9 ELSE key END AS key, value, expire_at FROM k WHERE key <> 9")
def key_rename(spark, d):
    k = keys(spark, d)
    return K.rename(K.rename(K.rename(k, 5, 9), 9, 9), -4, 9)  # the same name and a missing source change nothing


@query(f"WITH {KEYS} SELECT db, CASE WHEN key = 5 THEN -9 ELSE key END AS key, value, expire_at FROM k")
def key_renamenx(spark, d):
    return K.rename_nx(K.rename_nx(keys(spark, d), 5, -9), 6, 9)


@query(f"WITH {KEYS} SELECT db, key, value, expire_at FROM k UNION ALL SELECT db, -3, value, expire_at FROM k WHERE key = 3")
def key_copy(spark, d):
    return K.copy(K.copy(keys(spark, d), 3, -3), 4, 5)


@query(f"WITH {KEYS} SELECT CASE WHEN key = 4 THEN 2 ELSE db END AS db, key, value, expire_at FROM k")
def key_move(spark, d):
    return C.move_db(keys(spark, d), 4, 1, 2)


@query(f"WITH {KEYS} SELECT CASE db WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE db END AS db, key, value, expire_at FROM k")
def key_swapdb(spark, d):
    return C.swap_db(keys(spark, d), 0, 2)


@query(f"WITH {KEYS} SELECT db, key, value, expire_at FROM k WHERE db <> 1")
def key_flushdb(spark, d):
    return C.flush(keys(spark, d), 1)


@query(f"WITH {KEYS} SELECT db, key, value, expire_at FROM k")
def key_msetnx(spark, d):
    k = keys(spark, d)
    return K.set_all_or_none(k, k.where("key = 3").unionByName(k.where("key = 3").withColumn("key", F.lit(-1).cast("long"))), ["key"])


@query("SELECT event_id, '__keyspace@0__:' || user_id AS channel, CASE WHEN event_id % 9 = 0 THEN 'del' ELSE 'set' END AS event FROM events")
def key_notifications(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("value"))
    return C.notifications(log, ["user_id"], "event_id", "value")


# ---- streams, queues, versions

STREAM = "s AS (SELECT user_id AS key, event_id // 4 AS id_ms, event_id % 4 AS id_seq, event_type AS what FROM events)"


def stream(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor(e / 4).alias("id_ms"), (e % 4).alias("id_seq"), F.col("event_type").alias("what"))


@query(f"WITH {STREAM} SELECT * FROM s WHERE id_ms > 30 OR (id_ms = 30 AND id_seq >= 2)")
def stream_xtrim_minid(spark, d):
    return P.trim_before(stream(spark, d), (30, 2))


@query(f"WITH {STREAM} SELECT key, count(*) AS length, min(id_ms * 4 + id_seq) AS first, max(id_ms * 4 + id_seq) AS last FROM s GROUP BY key")
def stream_xinfo(spark, d):
    i = P.stream_info(stream(spark, d))
    flat = lambda c: (F.col(f"{c}.id_ms") * 4 + F.col(f"{c}.id_seq")).alias(c)
    return i.select("key", "length", flat("first"), flat("last"))


@query(f"WITH {STREAM} SELECT id_ms, id_seq, key, what FROM s WHERE key = 4 AND id_ms BETWEEN 10 AND 200 ORDER BY id_ms DESC, id_seq DESC LIMIT 9")
def stream_xrevrange(spark, d):
    return P.stream_range(stream(spark, d).where("key = 4"), (10, 0), (200, 3), 9, desc=True).select("id_ms", "id_seq", "key", "what")


@query("SELECT user_id AS key, ts_ms AS id_ms, row_number() OVER (PARTITION BY user_id, ts_ms ORDER BY event_id) - 1 AS id_seq FROM (SELECT *, event_id // 8 AS ts_ms FROM events)")
def stream_xadd(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.floor(F.col("event_id") / 8).alias("id_ms"), F.col("event_id").alias("ord"))
    none = e.where("false").select("key", "id_ms", F.lit(0).cast("long").alias("id_seq"))
    half = P.append(none, e.where("ord % 8 < 4"))
    return P.append(half, e.where("ord % 8 >= 4"))


def groups(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("g").alias("group"), F.lit(20).cast("long").alias("last_ms"), F.lit(1).cast("long").alias("last_seq"))


def delivered(spark, d):
    none = spark.createDataFrame([], "key long, group string, id_ms long, id_seq long, consumer string, delivered_ms long, deliveries int")
    return P.deliver(stream(spark, d), groups(spark, d), none, "c1", 1000, 3)


FRESH = f"{STREAM}, n AS (SELECT s.* FROM s JOIN customer ON c_custkey = key WHERE id_ms > 20 OR (id_ms = 20 AND id_seq > 1) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id_ms, id_seq) <= 3)"


@query(f"WITH {FRESH} SELECT key, id_ms, id_seq, 'c1' AS consumer, 1 AS deliveries FROM n")
def stream_xreadgroup(spark, d):
    return delivered(spark, d)[1].select("key", "id_ms", "id_seq", "consumer", "deliveries")


@query(f"WITH {FRESH}, g AS (SELECT key, count(*) AS pending, max(id_ms * 4 + id_seq) AS last FROM n GROUP BY key) SELECT c_custkey AS key, CASE WHEN pending > 0 THEN 1 ELSE 0 END::BIGINT AS consumers, coalesce(pending, 0) AS pending, coalesce(last, 81) AS last FROM customer LEFT JOIN g ON key = c_custkey")
def stream_xinfo_groups(spark, d):
    _, pel, after = delivered(spark, d)
    return P.group_info(after, pel).select("key", "consumers", "pending", (F.col("last_ms") * 4 + F.col("last_seq")).alias("last"))


@query(f"WITH {FRESH} SELECT key, id_ms, id_seq, what FROM n WHERE id_ms > 25")
def stream_xreadgroup_history(spark, d):
    return P.history(stream(spark, d), delivered(spark, d)[1], "c1", 25).select("key", "id_ms", "id_seq", "what")


PEL = "p AS (SELECT event_id AS id_ms, 'c' || event_id % 3 AS consumer, event_id * 2 AS delivered_ms, (event_id % 5)::INT AS deliveries FROM events WHERE event_id % 4 = 0)"


@query(f"WITH {PEL} SELECT id_ms, consumer, 5000 - delivered_ms AS idle, deliveries FROM p WHERE id_ms BETWEEN 50 AND 2000 AND 5000 - delivered_ms >= 3000 AND consumer = 'c1' ORDER BY id_ms LIMIT 40")
def stream_xpending_range(spark, d):
    e = F.col("event_id")
    pel = table(spark, d, "events").where("event_id % 4 = 0").select(e.alias("id_ms"), F.concat(F.lit("c"), (e % 3).cast("string")).alias("consumer"), (e * 2).alias("delivered_ms"), (e % 5).cast("int").alias("deliveries"))
    return P.pending_range(pel, 50, 2000, 40, idle=3000, now=5000, consumer="c1")


QUEUE = "q AS (SELECT event_id AS id, (event_id % 5)::INT AS deliveries, event_id % 2 = 0 AS claimed FROM events), f AS (SELECT * FROM q WHERE NOT claimed ORDER BY id LIMIT 200)"


def queue(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("id"), (e % 5).cast("int").alias("deliveries"), (e % 2 == 0).alias("claimed"))


@query(f"WITH {QUEUE} SELECT id, deliveries + 1 AS deliveries FROM f WHERE deliveries < 3")
def mq_pop(spark, d):
    return P.queue_pop(queue(spark, d), 200, 3)[0]


@query(f"WITH {QUEUE} SELECT id, deliveries FROM f WHERE deliveries >= 3")
def mq_dead_letters(spark, d):
    return P.queue_pop(queue(spark, d), 200, 3)[1]


@query(f"WITH {QUEUE} SELECT q.id, CASE WHEN f.id IS NULL THEN q.deliveries ELSE q.deliveries + 1 END AS deliveries, q.claimed OR f.id IS NOT NULL AS claimed FROM q LEFT JOIN f ON f.id = q.id WHERE f.id IS NULL OR f.deliveries < 3")
def mq_after_pop(spark, d):
    return P.queue_pop(queue(spark, d), 200, 3)[2]


@query("SELECT user_id AS key, event_id AS at_ms FROM (SELECT *, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) WHERE gap IS NULL OR gap > 60")
def mq_debounce(spark, d):
    return P.debounced(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at_ms")), 60)


@query("SELECT event_id FROM events WHERE (event_id % 7 = 5 OR (event_id % 7 < 4 AND event_id <= 400)) AND (event_id % 3 > 0 OR event_id + 100 > 400)")
def temporal_mvcc(spark, d):
    e = F.col("event_id")
    v = table(spark, d, "events").select("event_id", e.alias("insert_lsn"), F.when(e % 3 == 0, e + 100).otherwise(0).alias("delete_lsn"), (e % 7).alias("txn_id"))
    return P.visible(v, 400, 5, spark.createDataFrame([(1,), (2,), (3,)], "txn_id long")).select("event_id")


@query("WITH w AS (SELECT user_id, arg_min(CASE WHEN event_id % 2 = 0 THEN event_type END, event_id) FILTER (WHERE event_id % 2 = 0) AS before, arg_min(event_id, event_id) AS e FROM events WHERE event_id % 5 = 1 GROUP BY user_id), f AS (SELECT user_id, event_id, event_type FROM events WHERE event_id % 5 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) SELECT c_custkey AS user_id, CASE WHEN f.user_id IS NULL THEN c_name ELSE f.event_type END AS value FROM customer LEFT JOIN f ON f.user_id = c_custkey WHERE f.user_id IS NULL OR f.event_id % 2 = 0 UNION ALL SELECT f.user_id, f.event_type FROM f WHERE f.user_id NOT IN (SELECT c_custkey FROM customer) AND f.event_id % 2 = 0")
def txn_abort(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("value"))
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("order"), (F.col("event_id") % 5).alias("txn_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("before"))
    return P.undo(t, log, 1, ["user_id"])


@query("SELECT 's' || c_custkey AS subscriber, 'e/' || event_type || '/' || user_id AS channel, event_id AS message FROM events, customer WHERE c_custkey <= 40 AND ((c_custkey % 2 = 0 AND starts_with('e/' || event_type || '/' || user_id, 'e/click/' || c_custkey)) OR (c_custkey % 2 = 1 AND regexp_matches('e/' || event_type || '/' || user_id, '^e/.*/' || c_custkey || '[05]$')))")
def pubsub_globs(spark, d):
    m = table(spark, d, "events").select(F.concat_ws("/", F.lit("e"), "event_type", F.col("user_id").cast("string")).alias("channel"), F.col("event_id").alias("message"))
    c = F.col("c_custkey").cast("string")
    pattern = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("e/click/"), c, F.lit("*"))).otherwise(F.concat(F.lit("e/*/"), c, F.lit("[05]")))
    subs = table(spark, d, "customer").where("c_custkey <= 40").select(F.concat(F.lit("s"), c).alias("subscriber"), pattern.alias("pattern"), F.lit(True).alias("is_glob"))
    return P.publish(m, subs)


# ---- search and vectors


@query("SELECT lang, source, count(*) AS n, avg(n_chars)::DOUBLE AS mean, avg(n_chars) * count(*) AS total FROM documents GROUP BY ALL HAVING count(*) > 20")
def ft_aggregate_apply_filter(spark, d):
    reducers = {"n": ("COUNT", None), "mean": ("AVG", "n_chars")}
    return T.aggregate(table(spark, d, "documents"), ["lang", "source"], reducers, apply={"total": F.col("mean") * F.col("n")}, having=F.col("n") > 20)


@query("SELECT source, sum(n_chars)::DOUBLE AS total FROM documents GROUP BY source ORDER BY total DESC, source DESC LIMIT 3 OFFSET 1")
def ft_aggregate_sort_limit(spark, d):
    return T.aggregate(table(spark, d, "documents"), ["source"], {"total": ("SUM", "n_chars")}, sort_by=[("total", True), ("source", True)], offset=1, count=3)


@query("SELECT doc_id FROM documents WHERE NOT (lang = 'en' AND n_chars BETWEEN 100 AND 2000)")
def ft_invalidate_range(spark, d):
    return C.invalidate_range(table(spark, d, "documents"), "lang", "en", "n_chars", 100, 2000)[1].select("doc_id")


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({L2}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {L2}, e.vec_id)::INT AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10")
def vector_knn_join(spark, d):
    e = table(spark, d, "embeddings")
    got = V.knn_join(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, block=3)
    return got.withColumn("distance", F.round("distance", 6))


@query("WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), c AS (SELECT i, (avg(x) FILTER (WHERE vec_id IN (1, 2))) - 0.5 * sum(x) FILTER (WHERE vec_id = 3) AS x FROM e GROUP BY i), n AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM c), d AS (SELECT vec_id, 1 - sum(e.x * n.x) / sqrt(sum(e.x * e.x)) AS distance FROM e JOIN n USING (i) GROUP BY vec_id) SELECT vec_id, round(distance, 6) AS distance FROM d WHERE vec_id NOT IN (1, 2, 3) ORDER BY d.distance, vec_id LIMIT 10")
def vector_recommend(spark, d):
    return V.recommend(table(spark, d, "embeddings"), [1, 2], [3], 10, metric="COSINE").select("vec_id", F.round("distance", 6).alias("distance"))


# ---- graphs


@query(f"WITH RECURSIVE {EDGES.replace('e AS (', 'e0 AS (', 1).replace('FROM e UNION SELECT dst, src FROM e', 'FROM e0 UNION SELECT dst, src FROM e0')}, e AS (SELECT src, dst, weight FROM e0 UNION ALL SELECT dst, src, weight FROM e0), m AS (SELECT src, dst, min(weight) AS weight FROM e GROUP BY 1, 2), c0 AS (SELECT 2::BIGINT AS id, 0.0::DOUBLE AS cost), c1 AS (SELECT id, min(cost) AS cost FROM (SELECT * FROM c0 UNION ALL SELECT dst, cost + weight FROM c0 JOIN m ON src = id) GROUP BY id), c2 AS (SELECT id, min(cost) AS cost FROM (SELECT * FROM c1 UNION ALL SELECT dst, cost + weight FROM c1 JOIN m ON src = id) GROUP BY id) SELECT id, min(cost) AS cost FROM (SELECT * FROM c2 UNION ALL SELECT dst, cost + weight FROM c2 JOIN m ON src = id) GROUP BY id")
def graph_shortest_multi_hop(spark, d):
    e = edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))
    return G.shortest(both, spark.createDataFrame([(2,)], "id long"), 3)


BOTH = EDGES.replace("e AS (", "e0 AS (", 1).replace("FROM e UNION SELECT dst, src FROM e", "FROM e0 UNION SELECT dst, src FROM e0") + ", m AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM e0 UNION ALL SELECT dst, src, weight FROM e0) GROUP BY 1, 2)"


def both_ways(spark, d):
    e = edges(spark, d)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))


@query(f"WITH {BOTH}, p1 AS (SELECT [2, dst] AS path, weight AS cost FROM m WHERE src = 2), p2 AS (SELECT list_append(path, dst) AS path, cost + weight AS cost FROM p1 JOIN m ON src = path[-1]), a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT [2::BIGINT], 0.0), z AS (SELECT path[-1] AS id, cost, path FROM a QUALIFY row_number() OVER (PARTITION BY path[-1] ORDER BY cost, path) = 1) SELECT id, cost, array_to_string(path, '>') AS path FROM z")
def graph_shortest_path(spark, d):
    got = G.shortest_paths(both_ways(spark, d), spark.createDataFrame([(2,)], "id long"), 2)
    return got.select("id", "cost", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"WITH {BOTH}, p0 AS (SELECT src, dst, weight FROM (SELECT src, dst, weight FROM e0 UNION ALL SELECT dst, src, weight FROM e0)), p1 AS (SELECT [2, dst] AS path, weight AS cost FROM p0 WHERE src = 2 AND weight <= 30), p2 AS (SELECT list_append(path, dst) AS path, cost + weight AS cost FROM p1 JOIN p0 ON src = path[-1] WHERE NOT list_contains(path, dst) AND cost + weight <= 30) SELECT array_to_string(path, '>') AS path, cost FROM p1 UNION ALL SELECT array_to_string(path, '>'), cost FROM p2")
def graph_cost_paths(spark, d):
    got = G.cost_paths(both_ways(spark, d), spark.createDataFrame([(2,)], "id long"), 2, 30.0)
    return got.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "cost")


def plain_nodes(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


NODES = "n AS (SELECT c_custkey * 2 AS id, c_name AS name, c_acctbal AS balance FROM customer)"


@query(f"WITH {EDGES} SELECT src, dst, weight FROM e UNION ALL SELECT c_custkey * 2, (c_custkey * 3) % 500 * 2, 1.0 FROM customer WHERE c_custkey * 2 <> (c_custkey * 3) % 500 * 2 AND (c_custkey * 3) % 500 IN (SELECT c_custkey FROM customer)")
def graph_create_edges(spark, d):
    c = F.col("c_custkey")
    new = table(spark, d, "customer").select((c * 2).alias("src"), (c * 3 % 500 * 2).alias("dst"), F.lit("NEW").alias("type"), F.lit(1.0).alias("weight"))
    return G.create_edges(edges(spark, d), new, plain_nodes(spark, d)).select("src", "dst", "weight")


@query(f"WITH {NODES} SELECT * FROM n UNION ALL SELECT s_suppkey * 2 + 1000001, s_name, s_acctbal FROM supplier WHERE s_name NOT IN (SELECT name FROM n)")
def graph_merge_nodes(spark, d):
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1000001).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    mine = plain_nodes(spark, d)
    return G.merge_nodes(mine, wanted.unionByName(mine), ["name"])


def flat(nodes):
    return nodes.select("id", F.element_at("labels", 1).alias("label"), F.col("props.name").alias("name"), F.col("props.balance").alias("balance"))


FLAT = "n AS (SELECT c_custkey * 2 AS id, 'Customer' AS label, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT p_partkey * 2 + 1, 'Part', p_name, NULL FROM part)"


@query(f"WITH {FLAT} SELECT label, name, balance, id IN (SELECT id FROM n) AS old FROM n UNION ALL SELECT 'Alert', name, balance, false FROM n WHERE label = 'Customer' AND balance < 0")
def graph_cypher_create(spark, d):
    before = nodes(spark, d)
    after, _ = execute("MATCH (c:Customer) WHERE c.balance < 0 CREATE (c)-[:RAISED]->(a:Alert {name: c.name, balance: c.balance})", before, edges(spark, d))
    old = before.select("id", F.lit(True).alias("_old"))
    return flat(after).join(old, "id", "left").select("label", "name", "balance", F.coalesce("_old", F.lit(False)).alias("old"))


@query("SELECT (c_acctbal < 0) AS low, count(*) AS customers FROM customer GROUP BY 1")
def graph_cypher_merge(spark, d):
    after, linked = execute("MATCH (c:Customer) WITH c, c.balance < 0 AS low MERGE (g:Group {name: toString(low)}) MERGE (c)-[:IN]->(g)", nodes(spark, d), edges(spark, d))
    return cypher("MATCH (c:Customer)-[:IN]->(g:Group) RETURN g.name = 'true' AS low, count(c) AS customers", after, linked)


@query(f"WITH {FLAT} SELECT id, label, name, CASE WHEN balance < 0 THEN 0.0 ELSE balance END AS balance FROM n")
def graph_cypher_set(spark, d):
    return flat(execute("MATCH (c:Customer) WHERE c.balance < 0 SET c.balance = 0.0", nodes(spark, d), edges(spark, d))[0])


@query(f"WITH {EDGES} SELECT src, count(*) AS n, sum(weight) AS weight FROM e WHERE src NOT IN (SELECT c_custkey * 2 FROM customer WHERE c_acctbal < 0) GROUP BY src")
def graph_cypher_delete(spark, d):
    _, left = execute("MATCH (c:Customer) WHERE c.balance < 0 DETACH DELETE c", nodes(spark, d), edges(spark, d))
    return left.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(f"WITH {NODES} SELECT id, name, CASE WHEN balance < 0 THEN 0.0 ELSE balance END AS balance FROM n")
def graph_set_properties(spark, d):
    return G.set_properties(plain_nodes(spark, d), F.col("balance") < 0, {"balance": F.lit(0.0)})


@query(f"WITH {EDGES}, {NODES} SELECT src, dst, weight FROM e WHERE src NOT IN (SELECT id FROM n WHERE balance < 0)")
def graph_detach_delete(spark, d):
    n = plain_nodes(spark, d)
    return G.delete_nodes(n, edges(spark, d), n.where("balance < 0"))[1].select("src", "dst", "weight")


# ---- written text indexes, fusion, approximate vectors

HITS = WORDS + """, d AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), p AS (SELECT doc_id, term, dl, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
b AS (SELECT doc_id, p.term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1))) AS score FROM p JOIN df USING (term), s)"""


def text_index(spark, d) -> str:
    root = scratch(spark, "indexes")
    I.create(spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit(""))), root, "docs", ["text"])
    return root


@query(f"WITH {HITS} SELECT doc_id, round(sum(score), 6) AS score FROM b WHERE term IN ('their', 'from', 'have') GROUP BY doc_id")
def ft_index_search(spark, d):
    return I.search(spark, text_index(spark, d), "docs", "text", [["their"], ["from"], ["have"]]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {HITS}, x AS (SELECT term FROM df WHERE starts_with(term, 'ha') ORDER BY df DESC, term LIMIT 50), y AS (SELECT term FROM df WHERE levenshtein(term, 'from') <= 1 ORDER BY df DESC, term LIMIT 50), g AS (SELECT doc_id, max(score) FILTER (WHERE term IN (SELECT term FROM x)) AS a, max(score) FILTER (WHERE term IN (SELECT term FROM y)) AS c FROM b GROUP BY doc_id) SELECT doc_id, round(coalesce(a, 0) + coalesce(c, 0), 6) AS score FROM g WHERE a IS NOT NULL OR c IS NOT NULL")
def ft_index_prefix_fuzzy(spark, d):
    root = text_index(spark, d)
    groups = [[t for t, _ in I.expand(spark, root, "docs", "text", prefix="ha")], [t for t, _ in I.expand(spark, root, "docs", "text", fuzzy=("from", 1))]]
    return I.search(spark, root, "docs", "text", groups).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {HITS} SELECT 'text' AS field, 'TEXT' AS kind, (SELECT n FROM s) AS n, round((SELECT avgdl FROM s), 6) AS avgdl, count(*) AS terms, sum(df)::BIGINT AS postings FROM df")
def ft_index_info(spark, d):
    return I.info(spark, text_index(spark, d), "docs").withColumn("avgdl", F.round("avgdl", 6))


@query("SELECT doc_id FROM documents WHERE (lower(source) LIKE 'src1%' OR lower(lang) = 'de') AND n_chars BETWEEN 200 AND 4000")
def ft_hybrid_filter(spark, d):
    return table(spark, d, "documents").where(I.parse_filter("AND 2 OR 2 TAG source SRC1* TAG lang de NUMERIC n_chars 200 4000".split())).select("doc_id")


@query(f"WITH {HITS}, f AS (SELECT doc_id FROM documents WHERE n_chars >= 300), a AS (SELECT doc_id, row_number() OVER (ORDER BY sc DESC, doc_id) - 1 AS r FROM (SELECT doc_id, sum(score) AS sc FROM b WHERE term IN ('their', 'from') AND doc_id IN (SELECT doc_id FROM f) GROUP BY doc_id)), v AS (SELECT e.vec_id AS doc_id, row_number() OVER (ORDER BY {L2}, e.vec_id) - 1 AS r FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id IN (SELECT doc_id FROM f)), u AS (SELECT doc_id, 1.0::DOUBLE / (r + 61) AS s FROM a WHERE r < 60 UNION ALL SELECT doc_id, 2.0::DOUBLE / (r + 61) FROM v WHERE r < 60) SELECT doc_id, round(sum(s), 9) AS score FROM u GROUP BY doc_id ORDER BY sum(s) DESC, doc_id LIMIT 20")
def ft_hybrid(spark, d):
    docs = table(spark, d, "documents").where("n_chars >= 300").select("doc_id")
    text = I.search(spark, text_index(spark, d), "docs", "text", [["their"], ["from"]]).join(docs, "doc_id", "left_semi")
    e = table(spark, d, "embeddings").join(docs.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi")
    return V.hybrid(text, e, table(spark, d, "embeddings").where("vec_id = 0").first().embedding, 20, weights=[1.0, 2.0]).select("doc_id", F.round("score", 9).alias("score"))


@query("SELECT vec_id AS query_id, true AS found FROM embeddings WHERE vec_id % 100 = 0")
def vector_ivf(spark, d):
    """Whether the inverted file finds at least 9 in 10 of the exact 10 nearest over all queries; the queries are every hundredth vector."""
    e = table(spark, d, "embeddings")
    path = scratch(spark, "ivf")
    centroids = A.build(e, path, 16)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = A.search(spark, path, centroids, q, 10, 12)
    exact = V.knn_join(e, q, 10)
    share = exact.join(got.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return q.select("query_id").crossJoin(F.broadcast(share)).select("query_id", (F.col("recall") >= 0.9).alias("found"))  # one row


# ---- change events


@query("SELECT user_id, event_id, lag(event_type) OVER w AS before, event_type AS after, CASE WHEN lag(event_type) OVER w IS NULL THEN 'c' ELSE 'u' END AS op, 'events' AS source FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY event_id >= 700 ORDER BY event_id LIMIT 256")
def cdc_read_from(spark, d):
    e = table(spark, d, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    feed = P.read_changes(P.envelopes(e, ["user_id"], "event_id", "event_type", "ts_ms", "events"), 700, order="event_id")
    return feed.select("user_id", "event_id", F.from_json("event", "before string, after string, op string, source string").alias("e")).select("user_id", "event_id", "e.*")
