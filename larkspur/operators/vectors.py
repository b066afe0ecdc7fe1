"""Dense and sparse vector search: exact distances, k nearest, fusion of ranked lists, recommendation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance; 1 if a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 1.0).otherwise(1.0 - dot(a, b) / n)


METRICS = {"L2": l2, "COSINE": cosine, "IP": lambda a, b: 2.0 - 2.0 * (1.0 - cosine(a, b))}  # IP ranks on the unit sphere


def knn(vectors: DataFrame, query: list[float], k: int, *, metric: str = "L2", vec: str = "embedding", id: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest of those that pass the filter; each task keeps k rows, ties by id."""
    rows = vectors if where is None else vectors.where(where)
    q = F.lit([float(x) for x in query])
    return rows.withColumn("distance", METRICS[metric](F.col(vec), q)).orderBy("distance", id).limit(k)


def closest(x: np.ndarray, at: np.ndarray, wanted: np.ndarray, k: int, metric: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): the k nearest rows of x, with ids at, for each row of wanted, `block` of those at a time.

    A matrix product shows which rows can be among the k, its rounding allowed for; their distances are then summed as they are.
    """
    if metric != "L2":
        x, wanted = (np.divide(v, n, out=np.zeros_like(v), where=n > 0) for v in (x, wanted) for n in [np.linalg.norm(v, axis=1, keepdims=True)])
    size, most = (x * x).sum(axis=1), min(k, len(x))
    found = []
    for start in range(0, len(wanted), block):
        q = wanted[start : start + block]
        own = (q * q).sum(axis=1)
        near = size[None, :] + own[:, None] - 2 * q @ x.T
        slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (size.max(initial=0) + own)
        row, col = np.nonzero(~(near > (np.partition(near, most - 1, axis=1)[:, most - 1] + slack)[:, None]))
        d = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            a, b = x[col[i : i + (1 << 16)]], q[row[i : i + (1 << 16)]]
            d[i : i + (1 << 16)] = ((a - b) ** 2).sum(axis=1) if metric == "L2" else 1.0 - (a * b).sum(axis=1)
        order = np.lexsort((at[col], d, row))
        row, col, d = row[order], col[order], d[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[best] + start, at[col[best]], d[best]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


#: Numbers in the vectors of a block; the vectors that meet in a task are two such blocks.
BLOCK_NUMBERS = 1 << 20
#: Distances computed at once.
BLOCK_PAIRS = 1 << 22


def block_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str, id: str, vec: str, block: int | None = None, cell: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): k nearest for each of queries (query_id, query), of the same cell where one is named.

    Every block of queries meets every block of vectors in some task, so what a task holds is bounded and neither the plan
    nor what the driver gets grows with the input. The pairs themselves are as many as there are; a query leaves k rows a block.
    """
    keys = [cell] if cell else []
    x = vectors.where(F.col(vec).isNotNull()).select(*keys, id, F.col(vec).cast("array<double>").alias(vec))
    q = queries.where(F.col("query").isNotNull()).select(*keys, "query_id", F.col("query").cast("array<double>").alias("query"))

    def parts(df: DataFrame, v: str) -> tuple[int, int]:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(v)).alias("dims")).agg(F.max("n"), F.max("dims")).first()  # one row
        n, dims = (c or 1 for c in counts)
        return -(-n * dims // BLOCK_NUMBERS), -(-n // 1024)

    (across, some), (down, _) = parts(x, vec), parts(q, "query")
    across = max(across, min(some, vectors.sparkSession.sparkContext.defaultParallelism // (1 if not cell else 4)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.withColumn("_x", dealt(id, across)).withColumn("_q", every(down))
    q = q.withColumn("_q", dealt("query_id", down)).withColumn("_x", every(across))

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            at = min(block or right.num_rows, max(1, BLOCK_PAIRS // left.num_rows))
            row, hit, d = closest(matrix(left, vec), left.column(id).to_numpy(), matrix(right, "query"), k, metric, at)
            found = [right.column("query_id").to_numpy()[row], hit, d]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", id, "distance"])

    on = [*keys, "_x", "_q"]
    met = x.groupBy(*on).cogroup(q.groupBy(*on)).applyInArrow(meet, f"query_id long, {id} long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", id)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", id, "distance", "rank")


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, *, metric: str = "L2", block: int = 1000, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """k nearest for each of a set of queries (query_id, query), all against all; at most `block` queries are compared at once."""
    return block_search(vectors, queries, k, metric, id, vec, block)


def within(vectors: DataFrame, query: list[float], threshold: float, *, metric: str = "L2", vec: str = "embedding") -> DataFrame:
    """RANGE search: L2 keeps distances up to the threshold, COSINE and IP similarities from it on."""
    q = F.lit([float(x) for x in query])
    d = METRICS[metric](F.col(vec), q)
    return vectors.withColumn("distance", d).where(d <= threshold if metric == "L2" else (1.0 - d) >= threshold)


def sparse_scores(docs: DataFrame, query: dict[int, float], *, id: str = "doc_id", dims: str = "weights") -> DataFrame:
    """Sparse dot product of map columns with a query, best first."""
    got = docs.select(id, F.explode(dims).alias("dim", "w")).where(F.col("dim").isin(list(query)))
    weight = reduce(lambda c, kv: F.when(F.col("dim") == kv[0], kv[1]).otherwise(c), query.items(), F.lit(0.0))
    return got.groupBy(id).agg(F.sum(F.col("w") * weight).alias("score")).orderBy(F.col("score").desc(), id)


def rrf(streams: list[DataFrame], k: int, *, id: str = "doc_id", weights: list[float] | None = None, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists (id, rank from 0); a weight that is not above 0 turns its list off."""
    weights = weights or [1.0] * len(streams)
    parts = [s.select(id, (F.lit(w) / (F.col("rank") + c + 1)).alias("part")) for s, w in zip(streams, weights, strict=True) if w > 0]
    return reduce(DataFrame.unionByName, parts).groupBy(id).agg(F.sum("part").alias("score")).orderBy(F.col("score").desc(), id).limit(k)


def hybrid(text: DataFrame, vectors: DataFrame, query: list[float], k: int, *, sparse: DataFrame | None = None, weights: list[float] | None = None, per_stream: int | None = None, metric: str = "L2", id: str = "vec_id") -> DataFrame:
    """HYBRID: text scores (doc_id, score), k nearest vectors and sparse scores fused by rank; filters are applied to all by the caller.

    Each stream gives its best max(60, 3 k).
    """
    n = per_stream or max(60, 3 * k)

    def ranked(scored: DataFrame) -> DataFrame:
        best = scored.orderBy(F.col("score").desc(), "doc_id").limit(n)
        return best.select("doc_id", (F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")) - 1).alias("rank"))  # n rows

    near = knn(vectors, query, n, metric=metric, id=id).select(F.col(id).alias("doc_id"), (-F.col("distance")).alias("score"))
    streams = [ranked(text), ranked(near), *([] if sparse is None else [ranked(sparse)])]
    return rrf(streams, k, weights=weights)


def centroid(vectors: DataFrame, vec: str = "embedding") -> Column:
    """Mean of vectors as an aggregate over positions; use with one group."""
    return vectors.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def recommend(vectors: DataFrame, positive: list[int], negative: list[int], k: int, *, metric: str = "L2", vec: str = "embedding", id: str = "vec_id") -> DataFrame:
    """Nearest to the positives' mean less half of each negative, without the examples."""
    up, down = (vectors.where(F.col(id).isin(ids)).select(F.posexplode(vec).alias("i", "x")) for ids in (positive, negative))
    mean = up.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    if negative:
        mean = mean.join(down.groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("y")), "i", "left").select("i", (F.col("x") - 0.5 * F.coalesce("y", F.lit(0.0))).alias("x"))
    query = [r.x for r in mean.orderBy("i").collect()]  # as many rows as dimensions
    norm = math.sqrt(sum(x * x for x in query))
    if metric == "COSINE" and norm:
        query = [x / norm for x in query]
    return knn(vectors, query, k, metric=metric, vec=vec, id=id, where=~F.col(id).isin([*positive, *negative]))


def cache_search(vectors: DataFrame, query: list[float], threshold: float, k: int, *, prefix: str, key: str = "key", metric: str = "L2", id: str = "vec_id") -> DataFrame:
    """The nearest entry under a key prefix if it is within the threshold, else the k nearest of all; cached tells which."""
    hit = within(vectors.where(F.col(key).startswith(prefix)), query, threshold, metric=metric).orderBy("distance", id).limit(1)
    none = hit.agg(F.count(F.lit(1)).alias("_hits"))  # one row
    rest = knn(vectors, query, k, metric=metric, id=id).crossJoin(F.broadcast(none)).where("_hits = 0").drop("_hits")
    return hit.withColumn("cached", F.lit(True)).unionByName(rest.withColumn("cached", F.lit(False)))


def unseen(results: DataFrame, session: DataFrame, id: str = "doc_id") -> DataFrame:
    """SESSION: results that the session's table has not returned before; the caller appends them to it."""
    return results.join(session.select(id), id, "left_anti")
