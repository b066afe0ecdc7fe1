"""Mixing sources to target weights by capped water-filling.

Each source wants its weight's part of the mix; a source that would need more than ``most`` per cent of its own size
is clamped there and what it leaves is dealt out again by weight, until none is above. With sources in order of
size by weight the clamped ones are a prefix, so one pass of running sums over the sources gives the fixed point.

A target is whole repetitions of every document plus a fraction: documents enter it in the order of a seeded hash of
their ids until the next would pass the target, and one more fills the rest best. The cut is found from sums over
1,024 ranges of the hash, then inside one range of each source, so no task orders a whole source.

All of it is one row a source in the end, joined to the documents; the documents themselves are not shuffled while
that table is small enough to be broadcast.

Defined results: a null text has size 0; null sources are one source, the last; rows with equal ids are taken
together; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, own, small, stash, words

BITS, RANGE_BITS = 60, 50
WEIGHTS = (5, 2, 1)


def hashed(doc_id: Column, seed: str) -> Column:
    """A seeded number below 2**60 for each id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, BITS // 4), 16, 10).cast("long")


def water_fill(sizes: DataFrame, share: int, most: int) -> DataFrame:
    """sizes (source, size, weight) with target: share per cent of all sizes by weight, at most ``most`` per cent of a size."""
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("size") / F.col("weight"), "rank")
    s = sizes.withColumn("cap", F.col("size") * most).withColumn("all", F.sum("size").over(everywhere) * share)
    s = s.withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    left = F.col("all") - F.col("caps")
    s = s.withColumn("free", F.col("cap").cast("double") * F.col("weights") >= F.col("weight").cast("double") * left)
    # the first source that is not clamped sets the level of those that follow it
    level = F.min(F.when(F.col("free"), F.struct(F.col("size") / F.col("weight"), "rank", left.alias("left"), F.col("weights").alias("weights")))).over(everywhere)
    s = s.withColumn("level", level)
    target = F.when(F.col("free"), F.col("weight") * F.col("level.left") / (100 * F.col("level.weights"))).otherwise(F.col("cap") / 100)
    return s.withColumn("target", target)


def plan_mix(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: int = 150, most: int = 200, seed: str = "mix-0:") -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, source, size, u; sources as source, source_size, target, whole, cut, pick)."""
    base = own(docs, doc_id, source, text).toDF("doc_id", "source", "text")
    narrow = stash(base.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), hashed(F.col("doc_id"), seed).alias("u")), "sizes")
    ranges = stash(narrow.groupBy("source", F.shiftright("u", RANGE_BITS).alias("range")).agg(F.sum("size").alias("size")), "ranges")
    sizes = ranges.groupBy("source").agg(F.sum("size").alias("size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1).cast("long"))
    filled = water_fill(sizes, share, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    goals = stash(filled.select("source", F.col("size").alias("source_size"), "target", whole.alias("whole")).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    # the range in which the fraction ends, and the words in the ranges before it
    run = F.sum("size").over(Window.partitionBy("source").orderBy("range"))
    at = ranges.withColumn("upto", run).join(small(goals.select(F.col("source").alias("s"), "part")), F.col("source").eqNullSafe(F.col("s")))
    ends = at.where("upto > part").groupBy("source").agg(F.min(F.struct("range", (F.col("upto") - F.col("size")).alias("before"))).alias("end"))
    ends = stash(ends.select(F.col("source").alias("s"), "end.range", "end.before"), "ends")
    close = narrow.withColumn("range", F.shiftright("u", RANGE_BITS)).join(small(ends.withColumnRenamed("range", "r")), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("u"))
    inside = close.withColumn("upto", upto).join(small(goals.select(F.col("source").alias("s"), "part")), F.col("source").eqNullSafe(F.col("s"))).where("upto <= part")
    inside = inside.groupBy("s").agg(F.max(F.struct("u", "upto")).alias("last"))
    g = goals.join(ends, goals.source.eqNullSafe(ends.s), "left").drop("s")
    g = g.join(inside.withColumnRenamed("s", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    cut = F.coalesce("last.u", F.shiftleft("range", RANGE_BITS) - 1, F.when(F.col("part") > 0, F.lit((1 << BITS) - 1)).otherwise(-1))
    rest = F.when(F.col("range").isNotNull(), F.col("part") - F.coalesce("last.upto", "before")).otherwise(0)
    g = stash(g.select("source", "source_size", "target", "whole", cut.alias("cut"), rest.alias("rest")), "cuts")
    miss = F.abs(F.col("size") - F.col("rest"))
    best = narrow.join(small(g.select(F.col("source").alias("s"), "cut", "rest")), F.col("source").eqNullSafe(F.col("s")))
    best = best.where((F.col("u") > F.col("cut")) & (miss < F.col("rest"))).groupBy("s").agg(F.min(F.struct(miss, "u")).alias("best"))
    sources = g.join(best.select("s", F.col("best.u").alias("pick")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return narrow, stash(sources, "sources")


def repetitions(u: Column) -> Column:
    return F.col("whole") + (u <= F.col("cut")).cast("long") + F.coalesce(u == F.col("pick"), F.lit(False)).cast("long")


def mix(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", seed: str = "mix-0:", **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    flat, source, doc_id, text = numbered(docs, source, doc_id, text)
    _, sources = plan_mix(flat, source=source, doc_id=doc_id, text=text, seed=seed, **options)
    sources = small(sources.withColumnRenamed("source", "_mixed"))
    found = flat.join(sources, F.col(source).eqNullSafe(F.col("_mixed"))).withColumn("_times", repetitions(hashed(F.col(doc_id), seed)))
    return found.where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).select(*flat.columns).toDF(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    narrow, sources = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = narrow.join(small(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * repetitions(F.col("u"))).alias("taken"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(size) OVER () AS total FROM s1),
s3 AS (SELECT *, coalesce(sum(200 * size) OVER (ORDER BY size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s2),
s4 AS (SELECT *, 200.0 * size * weights >= weight * (150 * total - caps) AS free FROM s3),
lv AS (SELECT (150 * total - caps)::DOUBLE AS l, weights AS w FROM s4 WHERE free ORDER BY size / weight, rank LIMIT 1),
t AS (SELECT source, size AS source_size, CASE WHEN free THEN (weight * (SELECT l FROM lv))::DOUBLE / (100 * (SELECT w FROM lv))::DOUBLE ELSE 200 * size / 100.0::DOUBLE END AS target FROM s4),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS part,
    sum(size) OVER (PARTITION BY d.source ORDER BY u) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT source, max(CASE WHEN upto <= part THEN upto ELSE 0 END) AS done FROM c GROUP BY source),
x AS (SELECT c.*, part - done AS rest, abs(size - (part - done)) AS miss FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source),
p AS (SELECT source, min(struct_pack(miss := miss, u := u)).u AS pick FROM x WHERE upto > part AND miss < rest GROUP BY source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (whole + (upto <= part)::INT + coalesce((u = pick)::INT, 0)))::BIGINT AS taken
FROM x LEFT JOIN p ON x.source IS NOT DISTINCT FROM p.source
"""
