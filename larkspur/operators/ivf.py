"""Approximate nearest neighbours: an inverted file of k-means cells, searched cell by cell.

The centroids are fitted on at most ``sample`` vectors taken by hash (a documented bound); every vector is dealt to its
nearest cell and written by cell. A query looks into its ``probes`` nearest cells only; recall is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import block_search


def fit(vectors: DataFrame, cells: int, *, sample: int = 20_000, rounds: int = 10, id: str = "vec_id", vec: str = "embedding") -> np.ndarray:
    """Centroids by Lloyd's rounds over a bounded sample, begun at its first vectors by hash."""
    rows = vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id), id).limit(sample).select(vec).collect()
    x = np.array([r[0] for r in rows], np.float64)
    c = x[:cells].copy()
    for _ in range(rounds):
        at = nearest_cells(x, c, 1)[:, 0]
        for k in range(len(c)):
            if (at == k).any():
                c[k] = x[at == k].mean(axis=0)
    return c


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def assign(centroids: np.ndarray, probes: int, id: str, vec: str):
    """The function for mapInArrow: a row for each of a vector's nearest cells."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(vec))
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) if len(batch) else np.empty((0, centroids.shape[1]))
            cells = nearest_cells(x, centroids, probes)
            pick = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
            yield pa.record_batch([pa.array(cells.reshape(-1).astype(np.int32)), batch.column(batch.schema.get_field_index(id)).take(pick), v.take(pick)], names=["cell", id, vec])

    return rows


def build(vectors: DataFrame, path: str, cells: int, *, id: str = "vec_id", vec: str = "embedding", **options) -> np.ndarray:
    """Write every vector by cell; returns the centroids."""
    centroids = fit(vectors, cells, id=id, vec=vec, **options)
    dealt = vectors.where(F.col(vec).isNotNull()).select(id, vec).mapInArrow(assign(centroids, 1, id, vec), f"cell int, {id} long, {vec} array<float>")
    dealt.repartition("cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    return centroids


def search(spark: SparkSession, path: str, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, *, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, distance): the k nearest in the probed cells for each of queries (query_id, query)."""
    wanted = queries.select("query_id", "query").mapInArrow(assign(centroids, probes, "query_id", "query"), "cell int, query_id long, query array<float>")
    return block_search(spark.read.parquet(path), wanted, k, "L2", id, vec, cell="cell")
