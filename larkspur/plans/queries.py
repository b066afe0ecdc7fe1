"""Registered queries of the keyed, search, vector, graph and temporal operators, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import sketches as H
from ..functions import strings as S
from ..operators import graph as G
from ..operators import keyed as K
from ..operators import search as T
from ..operators import temporal as P
from ..operators import vectors as V
from ..operators.cypher import cypher
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def zsets(spark, d) -> DataFrame:
    """Sorted sets of parts by supplier: key supplier, member part, score quantity."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).agg(F.max("l_quantity").alias("score"))


ZSETS = "z AS (SELECT l_suppkey AS key, l_partkey AS member, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"


def sets(spark, d) -> DataFrame:
    """Sets of customers by order status."""
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member"))


# ---- strings, bitmaps, geo


@query("SELECT c_custkey, CASE WHEN length(c_name) > 9 THEN substr(c_name, 10) ELSE '' END AS tail, strlen(c_name)::INT AS len FROM customer")
def string_getrange(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.get_range(F.col("c_name"), 9, -1).alias("tail"), F.octet_length("c_name").alias("len"))


@query("SELECT c_custkey, substr(c_name, 1, 3) || 'XY' || substr(c_name, 6) AS changed FROM customer")
def string_setrange(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.set_range(F.col("c_name"), 3, "XY").alias("changed"))


@query("SELECT user_id, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS value FROM events")
def string_incrby(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id")
    return K.running(log.withColumn("delta", F.col("event_id")), ["user_id"], "event_id", "delta").drop("delta")


@query("SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events")
def string_getset(spark, d):
    return K.get_set(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def string_set_last_wins(spark, d):
    return K.last_write(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("value")), ["user_id"], "event_id")


@query("SELECT k AS key, c_name AS value FROM (SELECT unnest(range(1, 400, 7)) AS k) LEFT JOIN customer ON c_custkey = k")
def string_mget(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return K.multi_get(t, spark.range(1, 400, 7).withColumnRenamed("id", "key")).select("key", "value")


@query("SELECT p_partkey, bit_count(encode(p_name)::BIT)::BIGINT AS bits FROM part")
def bitmap_bitcount(spark, d):
    return table(spark, d, "part").select("p_partkey", S.bit_count(F.col("p_name")).alias("bits"))


@query("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer#.*[13]$')")
def keys_glob(spark, d):
    return table(spark, d, "customer").where(S.matches(F.col("c_name"), "Customer#*[13]")).select("c_custkey")


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey > 20 ORDER BY 1 LIMIT 25")
def keys_scan_page(spark, d):
    return K.scan(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), 20, 25)


PLACES = "g AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat FROM customer)"


def places(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), (k * 37 % 3600 / 10.0 - 180).alias("lon"), (k * 53 % 1600 / 10.0 - 80).alias("lat"))


DIST = "2.0 * 6372797.560856 * asin(sqrt(pow(sin((radians(20.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin((radians(10.0) - radians(lon)) / 2), 2)))"


@query(f"WITH {PLACES} SELECT id, round({DIST} / 1000, 3) AS km FROM g WHERE {DIST} <= 3000000")
def geo_search_radius(spark, d):
    box = S.bounds(10.0, 20.0, 3e6)
    m = S.haversine(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(20.0))
    return places(spark, d).where(S.in_bounds(F.col("lon"), F.col("lat"), box) & (m <= 3e6)).select("id", F.round(m / 1000, 3).alias("km"))


@query()
def geo_hash(spark, d):
    p = S.geo_position(S.geo_score(F.col("lon"), F.col("lat")))
    return places(spark, d).select("id", S.geohash(F.col("lon"), F.col("lat")).alias("hash"), F.round(p["lon"], 4).alias("lon"), F.round(p["lat"], 4).alias("lat"))


# ---- hashes, lists, sets, sorted sets


@query("SELECT n_nationkey AS key, 'name' AS field, n_name AS value FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'name', 'CHANGED' UNION ALL SELECT 99, 'name', 'NEW'")
def hash_hset(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.lit("name").alias("field"), F.col("n_name").alias("value"))
    return K.upsert(t, spark.createDataFrame([(3, "name", "CHANGED"), (99, "name", "NEW")], "key int, field string, value string"), ["key", "field"])


@query("SELECT user_id AS key, event_type AS field, sum(event_id)::BIGINT AS value FROM events GROUP BY 1, 2")
def hash_hincrby(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), "event_id", F.col("event_id").alias("delta"))
    return K.last_write(K.running(log, ["key", "field"], "event_id", "delta"), ["key", "field"], "event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id * 10 < 500 THEN 0 ELSE (event_id * 10 - 500) // 1000 END AS ttl FROM events")
def hash_httl(spark, d):
    at = F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 10)
    return table(spark, d, "events").select("event_id", K.field_ttl(at, F.lit(500)).cast("long").alias("ttl"))


LISTS = "l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS i FROM orders GROUP BY 1)"


@query(f"WITH {LISTS} SELECT o_custkey, len(i)::INT AS n, i[2] AS second, i[-1] AS last, array_to_string(i[2:4], ',') AS part FROM l")
def list_lrange(spark, d):
    t = K.as_list(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey")
    i = F.col("items")
    return t.select("o_custkey", F.size(i).alias("n"), K.list_index(i, 1).alias("second"), K.list_index(i, -1).alias("last"), F.array_join(K.list_range(i, 1, 3), ",").alias("part"))


@query("SELECT o_custkey, array_to_string(list_filter(list(o_orderstatus ORDER BY o_orderkey), lambda x: x <> 'F'), ',') AS rest FROM orders GROUP BY 1")
def list_lrem(spark, d):
    t = K.as_list(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    return t.select("o_custkey", F.array_join(K.list_remove(F.col("items"), F.lit("F"), 0), ",").alias("rest"))


@query("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_sinter(spark, d):
    return K.set_inter(sets(spark, d), ["F", "O"])


@query("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_sunion(spark, d):
    return K.set_union(sets(spark, d), ["F", "P"])


@query("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_sdiff(spark, d):
    return K.set_diff(sets(spark, d), ["O", "P"])


@query("SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def set_sintercard(spark, d):
    return K.inter_card(sets(spark, d), ["F", "O"])


@query(f"WITH {ZSETS} SELECT key, member, score, (row_number() OVER (PARTITION BY key ORDER BY score, member) - 1)::INT AS rank FROM z")
def zset_zrank(spark, d):
    return K.ranked(zsets(spark, d))


@query(f"WITH {ZSETS}, r AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1)::INT AS rank FROM z) SELECT * FROM r WHERE rank BETWEEN 0 AND 4")
def zset_zrevrange(spark, d):
    return K.zrange(zsets(spark, d), 0, 4, desc=True)


@query(f"WITH {ZSETS} SELECT key, count(*) AS n FROM z WHERE score > 10 AND score <= 30 GROUP BY key")
def zset_zcount(spark, d):
    return zsets(spark, d).where(K.score_between("(10", "30")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ZSETS}, u AS (SELECT member, score * 2.0 AS score FROM z WHERE key = 1 UNION ALL SELECT member, score * 0.5 FROM z WHERE key = 2) SELECT member, sum(score) AS score FROM u GROUP BY member")
def zset_zunionstore(spark, d):
    z = zsets(spark, d)
    return K.zcombine([z.where("key = 1"), z.where("key = 2")], weights=[2.0, 0.5])


@query(f"WITH {ZSETS} SELECT a.member, least(a.score, b.score) AS score FROM z a JOIN z b USING (member) WHERE a.key = 1 AND b.key = 2")
def zset_zinterstore(spark, d):
    z = zsets(spark, d)
    return K.zcombine([z.where("key = 1"), z.where("key = 2")], aggregate="min", inter=True)


@query(f"WITH {ZSETS} SELECT member, score FROM z a WHERE key = 1 AND member NOT IN (SELECT member FROM z WHERE key = 2)")
def zset_zdiff(spark, d):
    z = zsets(spark, d)
    return K.zdiff(z.where("key = 1").select("member", "score"), z.where("key = 2"))


# ---- search


@query("SELECT source, count(*) AS n, sum(n_chars)::DOUBLE AS chars, avg(n_chars) AS mean, max(n_chars)::DOUBLE AS most, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def ft_aggregate(spark, d):
    return T.aggregate(table(spark, d, "documents"), ["source"], {"n": ("COUNT", None), "chars": ("SUM", "n_chars"), "mean": ("AVG", "n_chars"), "most": ("MAX", "n_chars"), "langs": ("COUNT_DISTINCT", "lang")})


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' AND n_chars > 500 AND n_chars <= 5000")
def ft_search_filter(spark, d):
    return table(spark, d, "documents").where(T.condition(T.parse("@source:{src1|SRC2} @lang:{en} @n_chars:[(500 5000]"), ["text"])).select("doc_id")


WORDS = f"t AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(coalesce(text, '')), '{T.MARKED}', '{T.FOLDED}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)})) AS w FROM documents)"


@query(f"""WITH {WORDS}, h AS (SELECT doc_id, len(w) AS dl, q AS term, len(list_filter(w, lambda x: x = q)) AS tf FROM t, (SELECT unnest(['their', 'from', 'have']) AS q)),
m AS (SELECT * FROM h WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM m GROUP BY term), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS score FROM m JOIN df USING (term), s GROUP BY doc_id""")
def ft_search_bm25(spark, d):
    got = T.bm25(spread(table(spark, d, "documents").select("doc_id", "text")), "text", ["their", "from", "have"])
    return got.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query(f"WITH {WORDS}, p AS (SELECT doc_id, unnest(w) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def ft_vocabulary(spark, d):
    p = T.postings(spread(table(spark, d, "documents").select("doc_id", "text")), ["text"])
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


# ---- vectors


def query_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first().embedding


L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"


@query(f"SELECT e.vec_id, round({L2}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {L2}, e.vec_id LIMIT 10")
def vector_knn(spark, d):
    return V.knn(table(spark, d, "embeddings"), query_vector(spark, d), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id, round({L2}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = q.label ORDER BY {L2}, e.vec_id LIMIT 10")
def vector_knn_filtered(spark, d):
    e = table(spark, d, "embeddings")
    label = e.where("vec_id = 0").first().label
    return V.knn(e, query_vector(spark, d), 10, where=F.col("label") == label).select("vec_id", F.round("distance", 6).alias("distance"))


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents), u AS (SELECT doc_id, 1.0::DOUBLE / (r + 61) AS s FROM a WHERE r < 100 UNION ALL SELECT doc_id, 1.0::DOUBLE / (r + 61) FROM b WHERE r < 100) SELECT doc_id, round(sum(s), 9) AS score FROM u GROUP BY doc_id")
def vector_rrf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    first = docs.orderBy(F.col("n_chars").desc(), "doc_id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_chars").desc(), "doc_id")) - 1)
    second = docs.orderBy("doc_id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")) - 1)
    return V.rrf([first, second], 200).select("doc_id", F.round("score", 9).alias("score"))


# ---- graphs: customers and parts, by orders


def edges(spark, d) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.lit("BOUGHT").alias("type"), F.col("l_quantity").alias("weight"))


EDGES = "e AS (SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_quantity AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"


@query(f"WITH {EDGES}, h1 AS (SELECT DISTINCT b AS id FROM b WHERE a = 2), h2 AS (SELECT DISTINCT b.b AS id FROM h1 JOIN b ON b.a = h1.id) SELECT 2::BIGINT AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 WHERE id <> 2 AND id NOT IN (SELECT id FROM h1)")
def graph_neighbors(spark, d):
    return G.neighbors(edges(spark, d), spark.createDataFrame([(2,)], "id long"), 2, "BOTH")


@query(f"WITH {EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT (sum(degree) / 2)::BIGINT AS edges, count(*) AS nodes, avg(degree) AS mean, quantile_cont(degree, 0.5)::DOUBLE AS median, max(degree) AS most FROM g")
def graph_info(spark, d):
    return G.degree_stats(edges(spark, d))


@query(f"WITH {EDGES} SELECT src AS id, count(DISTINCT dst) AS neighbours FROM e GROUP BY src")
def graph_cypher_expand_count(spark, d):
    return G.oriented(edges(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))


@query(f"WITH {EDGES} SELECT 2::BIGINT AS id, 0.0::DOUBLE AS cost UNION ALL SELECT dst, min(weight) FROM e WHERE src = 2 GROUP BY dst")
def graph_shortest(spark, d):
    return G.shortest(edges(spark, d), spark.createDataFrame([(2,)], "id long"), 3)


# ---- time


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 500 GROUP BY user_id")
def temporal_as_of(spark, d):
    return P.as_of(table(spark, d, "events"), 500, ["user_id"], "event_id")


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events")
def temporal_validity(spark, d):
    return P.validity(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT user_id AS key, event_id AS id_ms, 0::BIGINT AS id_seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def stream_xtrim(spark, d):
    return P.trim(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id_ms"), F.lit(0).cast("long").alias("id_seq")), 3)


@query("SELECT event_id AS id_ms, user_id AS id_seq FROM events WHERE event_id BETWEEN 100 AND 300 ORDER BY 1, 2 LIMIT 50")
def stream_xrange(spark, d):
    return P.stream_range(table(spark, d, "events").select(F.col("event_id").alias("id_ms"), F.col("user_id").alias("id_seq")), (100, 0), (300, 2**40), 50)


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'acked' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'ready' END AS state FROM events")
def mq_state(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return P.queue_state(e, e.where("id % 3 = 0"), e.where("id % 5 = 0"), 2).select("id", "state")


@query()
def cdc_read(spark, d):
    e = table(spark, d, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return P.envelopes(e, ["user_id"], "event_id", "event_type", "ts_ms", "events")


# ---- Cypher, over customers and parts


def nodes(spark, d) -> DataFrame:
    none = F.lit(None).cast("double")
    c = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.array(F.lit("Customer")).alias("labels"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), none.alias("price")).alias("props"))
    p = table(spark, d, "part").select((F.col("p_partkey") * 2 + 1).alias("id"), F.array(F.lit("Part")).alias("labels"), F.struct(F.col("p_name").alias("name"), none.alias("balance"), F.col("p_retailprice").alias("price")).alias("props"))
    return c.unionByName(p)


M = f"{EDGES}, m AS (SELECT src, dst, min(weight) AS w FROM e GROUP BY 1, 2)"


@query(f"WITH {M} SELECT c_name AS customer, count(*) AS n, sum(w) AS amount FROM m JOIN customer ON src = c_custkey * 2 JOIN part ON dst = p_partkey * 2 + 1 WHERE w >= 30 AND c_acctbal > 0 GROUP BY c_name")
def graph_cypher_match(spark, d):
    return cypher("MATCH (c:Customer)-[r:BOUGHT]->(p:Part) WHERE r.weight >= 30 AND c.balance > 0 RETURN c.name AS customer, count(*) AS n, sum(r.weight) AS amount", nodes(spark, d), edges(spark, d))


@query(f"WITH {EDGES}, h1 AS (SELECT DISTINCT b AS id FROM b WHERE a = 2), h2 AS (SELECT DISTINCT b.b AS id FROM h1 JOIN b ON b.a = h1.id WHERE b.b <> 2) SELECT id FROM h1 JOIN (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT p_partkey * 2 + 1 FROM part) USING (id) UNION SELECT id FROM h2 JOIN (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT p_partkey * 2 + 1 FROM part) USING (id)")
def graph_cypher_var_length(spark, d):
    return cypher("MATCH (c:Customer)-[:BOUGHT*1..2]-(x) WHERE id(c) = $id RETURN id(x) AS id", nodes(spark, d), edges(spark, d), {"id": 2})


@query(f"WITH {M}, q AS (SELECT src, count(*) AS n FROM m JOIN part ON dst = p_partkey * 2 + 1 WHERE p_retailprice > 1500 GROUP BY src) SELECT c_custkey * 2 AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN q ON src = c_custkey * 2")
def graph_cypher_optional(spark, d):
    return cypher("MATCH (c:Customer) OPTIONAL MATCH (c)-[:BOUGHT]->(p:Part) WHERE p.price > 1500 RETURN id(c) AS id, count(p) AS n", nodes(spark, d), edges(spark, d))


@query(f"WITH {M} SELECT dst AS id, count(*) AS buyers, count(*) // 2 AS half FROM m JOIN customer ON src = c_custkey * 2 JOIN part ON dst = p_partkey * 2 + 1 GROUP BY dst HAVING count(*) > 5 ORDER BY buyers DESC, id LIMIT 20")
def graph_cypher_with(spark, d):
    return cypher("MATCH (p:Part)<-[:BOUGHT]-(c:Customer) WITH p, count(*) AS n WHERE n > 5 RETURN id(p) AS id, n AS buyers, n / 2 AS half ORDER BY buyers DESC, id LIMIT 20", nodes(spark, d), edges(spark, d))


# ---- bits, sketches, subsequences


@query("SELECT c_custkey, lower(substr(c_name, 1, 1)) || substr(c_name, 2) AS flipped FROM customer")
def bitmap_bitop(spark, d):
    return table(spark, d, "customer").select("c_custkey", B.bit_op("XOR", F.col("c_name"), F.lit(" ")).cast("string").alias("flipped"))


@query("SELECT c_custkey, lower(substr(c_name, 1, 1)) || substr(c_name, 2) AS changed FROM customer")
def bitmap_setbit(spark, d):
    return table(spark, d, "customer").select("c_custkey", B.set_bit(F.col("c_name"), 2, 1).cast("string").alias("changed"))


@query("SELECT p_partkey, ord(substr(p_name, 2, 1))::BIGINT AS second, (ord(substr(p_name, 3, 1)) + 200) % 256 AS added FROM part")
def bitmap_bitfield(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", B.field_get(name, "u8", 8).alias("second"), B.field_add(name, "u8", 16, F.lit(200)).cast("int").alias("added"))


@query("SELECT DISTINCT o_orderstatus, true AS near FROM orders")
def hll_pfcount(spark, d):
    o = table(spark, d, "orders").withColumn("part", F.col("o_orderkey") % 8)
    parts = o.groupBy("o_orderstatus", "part").agg(H.pf_add(F.col("o_custkey")).alias("sketch"))
    merged = parts.groupBy("o_orderstatus").agg(H.pf_count(H.pf_merge(F.col("sketch"))).alias("estimate"))
    exact = o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"))
    return merged.join(exact, "o_orderstatus").select("o_orderstatus", (F.abs(F.col("estimate") - F.col("n")) <= F.greatest(0.03 * F.col("n"), F.lit(1.0))).alias("near"))


@query()
def string_lcs(spark, d):
    return table(spark, d, "part").select("p_partkey", B.lcs("p_name", "p_type").alias("common"))


# ---- more keyed, stream and search queries


@query(f"WITH {ZSETS} SELECT key, member, greatest(score, 25.0) AS score FROM z")
def zset_zadd_gt(spark, d):
    z = zsets(spark, d)
    return K.zadd(z, z.withColumn("score", F.lit(25.0)), gt=True)


@query("SELECT count(*) AS n FROM customer WHERE c_name >= 'Customer#1' AND c_name < 'Customer#5'")
def zset_zlexcount(spark, d):
    return table(spark, d, "customer").where(K.lex_between("[Customer#1", "(Customer#5", "c_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN least(o_custkey, 500) WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 2 = 0 THEN 500 END AS expire_at FROM orders")
def key_expire_lt(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("expire_at"))
    return K.expire(o, F.col("o_orderkey") % 2 == 0, F.lit(500).cast("long"), "LT")


@query("SELECT p_partkey AS value, p_retailprice AS weight FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 15 OFFSET 5")
def key_sort(spark, d):
    p = table(spark, d, "part")
    by = p.select(F.col("p_partkey").alias("value"), F.col("p_retailprice").alias("weight"))
    return K.sort(p.select(F.col("p_partkey").alias("value")), by=by, desc=True, offset=5, count=15)


@query("SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def key_del(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return K.delete(table(spark, d, "orders").select("o_custkey"), gone, ["o_custkey"])


PEL = "p AS (SELECT user_id % 3 AS \"group\", user_id % 7 AS consumer, event_id AS id_ms FROM events)"


@query(f"WITH {PEL} SELECT \"group\", consumer, count(*) AS n, min(id_ms) AS low, max(id_ms) AS high FROM p GROUP BY 1, 2")
def stream_xpending(spark, d):
    e = table(spark, d, "events")
    return P.pending_summary(e.select((F.col("user_id") % 3).alias("group"), (F.col("user_id") % 7).alias("consumer"), F.col("event_id").alias("id_ms")))


@query("SELECT event_id AS id_ms, CASE WHEN event_id <= 300 THEN 'new' ELSE 'old' END AS consumer, CASE WHEN event_id <= 300 THEN 2 ELSE 1 END AS deliveries, CASE WHEN event_id <= 300 THEN 500 ELSE event_id END AS delivered_ms FROM events")
def stream_xclaim(spark, d):
    pel = table(spark, d, "events").select(F.col("event_id").alias("id_ms"), F.lit("old").alias("consumer"), F.lit(1).alias("deliveries"), F.col("event_id").alias("delivered_ms"))
    return P.claim(pel, "new", 200, 500).withColumn("delivered_ms", F.col("delivered_ms").cast("long"))


@query("SELECT 'a' AS subscriber, event_type AS channel, event_id AS message FROM events WHERE event_type = 'click' UNION ALL SELECT 'b', event_type, event_id FROM events WHERE event_type LIKE 'p%'")
def pubsub_publish(spark, d):
    m = table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("message"))
    return P.publish(m, spark.createDataFrame([("a", "click", False), ("b", "p*", True)], "subscriber string, pattern string, is_glob boolean"))


@query("SELECT o_orderkey, (SELECT arg_max(e.event_id, e.ts) FROM (SELECT user_id, event_id, epoch_ms(ts) * 1000000 + event_id AS ts FROM events) e WHERE e.user_id = o_custkey AND e.ts <= epoch_ms(o_orderdate) * 1000000) AS event_id FROM orders")
def temporal_as_of_join(spark, d):
    at = lambda c: F.unix_millis(F.col(c).cast("timestamp")) * 1000000
    e = table(spark, d, "events").select("user_id", "event_id", (at("ts") + F.col("event_id")).alias("at"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), at("o_orderdate").alias("at"))
    return P.as_of_join(o, e, ["user_id"], "at", "at", "event_id").select("o_orderkey", "event_id")


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, round(1 - {COS}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY 1 - {COS}, e.vec_id LIMIT 10")
def vector_knn_cosine(spark, d):
    return V.knn(table(spark, d, "embeddings"), query_vector(spark, d), 10, metric="COSINE").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND {COS} >= 0.2")
def vector_range(spark, d):
    return V.within(table(spark, d, "embeddings"), query_vector(spark, d), 0.2, metric="COSINE").select("vec_id")


@query("SELECT l_orderkey AS doc_id, sum(l_quantity * CASE l_linenumber WHEN 1 THEN 2.0 WHEN 3 THEN 0.5 END) AS score FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY 1")
def vector_sparse(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.sum("l_quantity").alias("w"))
    docs = li.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "w"))).alias("weights"))
    return V.sparse_scores(docs, {1: 2.0, 3: 0.5})


@query(f"WITH {WORDS} SELECT doc_id FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'hav'))) > 0 OR len(list_filter(w, lambda x: levenshtein(x, 'from') <= 1)) > 0")
def ft_search_prefix_fuzzy(spark, d):
    return table(spark, d, "documents").where(T.condition(T.parse("hav* | %from%"), ["text"])).select("doc_id")


from . import more  # noqa: E402, F401  further queries register themselves
