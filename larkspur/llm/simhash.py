"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Cut into k + ``bits`` blocks, two fingerprints that differ in at most ``bits`` of 64 agree in some k blocks, so each
distinct fingerprint goes to one bucket for each choice of k blocks. k grows with the number of fingerprints, so that an
average bucket has at most a thousand: for 3 bits k is 1 (4 buckets, of 16 bits each) up to 65 million fingerprints,
2 (10, of 25 bits) up to 33 billion, then 3 (20, of 32 bits). In a bucket the fingerprints are sorted by Gray rank; groups of neighbours form a node
that keeps the bits all of them share (mask and pattern), nodes form higher nodes in turn. A join of the tree with
itself goes down from the root and drops every pair of groups whose shared patterns already differ in too many bits.
The links found by a task are cut to a spanning forest, so its output is linear in its input; a bucket of more than
``split`` fingerprints is dealt out as pairs of parts. A task reads its buckets one after another.

Exact copies are one fingerprint from the start, and a component id is found for fingerprints, not documents.

Defined results: null and empty texts have fingerprint zero; with fewer words than a shingle the whole sequence is
the only shingle; a null id never is a component's id unless all ids of the component are null; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import textvec as tv
from .common import numbered, own, release, small, stash
from .components import components

FAN = 8
AT_ONCE = 1 << 18  # rows of buckets taken together


def prints(shingle: int, text: str, carry: list[str]):
    """The function for mapInArrow that puts a fingerprint in place of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part, data, off in tv.chunks(batch, text, tv.CHUNK // 2):
                data = tv.FOLD[data]
                starts, ends, first = tv.spans(data, off, tv.PLAIN)
                size = ends - starts
                joined = np.full(int(size.sum()) + len(size), 32, np.uint8)  # each word and one space
                joined[np.arange(len(joined) - len(size)) + np.repeat(np.arange(len(size)), size)] = data[tv.PLAIN[data]]
                starts = np.cumsum(size + 1) - size - 1
                ends, n = starts + size, np.diff(first)
                count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
                row = np.repeat(np.arange(len(n)), count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
                buf = joined.tobytes()
                h = [xxh64_intdigest(buf[a:b], 42) for a, b in zip(starts[at].tolist(), ends[at + np.minimum(n[row], shingle) - 1].tolist(), strict=True)] if len(row) else []
                bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                out = np.zeros(len(n), np.uint64)
                full = np.flatnonzero(count)
                if len(full):
                    sums = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
                    out[full] = np.packbits(2 * sums > count[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in carry), pa.array(out.view(np.int64))], names=[*carry, "fp"])

    return tv.lean(rows)


def fingerprints(docs: DataFrame, *, text: str = "text", carry: list[str], shingle: int = 3) -> DataFrame:
    """The carried columns and fp, the 64-bit fingerprint as a signed long."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "fp long"])
    return docs.select(*carry, text).mapInArrow(prints(shingle, text, carry), schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Forest:
    """One tree over each group's fingerprints in Gray order."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.fp, group = fp[order], group[order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(np.full(len(fp), full), self.fp, np.arange(len(fp) + 1))]  # mask, pattern, first child
        ones = zeros = self.fp
        while True:
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
            if len(first) == len(group):
                break
            index = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            head = np.flatnonzero(index % FAN == 0)
            ones, zeros, group = np.bitwise_and.reduceat(ones, head), np.bitwise_or.reduceat(zeros, head), group[head]
            self.levels.append((~(ones ^ zeros), ones, np.append(head, len(index))))

    def near(self, level: int, p: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
        """Whether the nodes p and q of a level may hold fingerprints with at most so many differing bits."""
        mask, pattern, _ = self.levels[level]
        return np.bitwise_count((pattern[p] ^ pattern[q]) & mask[p] & mask[q]) <= bits

    def links(self, bits: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of places (a < b) with at most so many differing bits."""
        roots = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if not level:
                yield a, b
                continue
            child = self.levels[level][2]
            step = max(1, most // FAN**2)
            for i in range(0, len(a), step):
                x, y = a[i : i + step], b[i : i + step]
                nx, ny = child[x + 1] - child[x], child[y + 1] - child[y]
                pair = np.repeat(np.arange(len(x)), nx * ny)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
                p, q = child[x][pair] + k // ny[pair], child[y][pair] + k % ny[pair]
                near = (p <= q) if level > 1 else (p < q)
                p, q = p[near], q[near]
                near = self.near(level - 1, p, q, bits)
                if near.any():
                    stack.append((level - 1, p[near], q[near]))


def whole_buckets(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """Blocks of rows, one line a column; rows come in order of buckets (the first two columns), and no block cuts one."""
    held, n = [np.empty((columns, 0), np.int64)], 0
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]))
        n += len(batch)
        if n >= AT_ONCE:  # all buckets but the last are whole
            rows = np.concatenate(held, axis=1)
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            if not last.all():
                yield rows[:, ~last]
            held, n = [rows[:, last]], 0
    rows = np.concatenate(held, axis=1)
    if rows.shape[1]:
        yield rows


def groups(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The number of each row's bucket."""
    return np.cumsum(np.concatenate([[False], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))


def spanning(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links between n places that connect what all of them connect."""
    root = np.arange(n)
    kept = [(root[:0], root[:0])]
    for a, b in links:
        while len(a):
            other = root[a] != root[b]
            a, b = a[other], b[other]
            if not len(a):
                break
            high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            top, pick = np.unique(high, return_index=True)  # one link for each root that gives way
            kept.append((a[pick], b[pick]))
            root[top] = low[pick]
            while (root[root] != root).any():
                root = root[root]
    a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
    return a, b


def forest_links(bits: int):
    """The function for mapInArrow: rows (k1, k2, fp) in order of buckets in, a spanning forest of their links out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, fp in whole_buckets(batches, 3):
            # a place stands for one fingerprint of one bucket; equal fingerprints of other buckets meet in components()
            forest = Forest(groups(k1, k2), fp.view(np.uint64))
            a, b = spanning(forest.links(bits), len(forest.fp))
            if len(a):
                yield pa.record_batch([pa.array(forest.fp[a].view(np.int64)), pa.array(forest.fp[b].view(np.int64))], names=["a", "b"])

    return tv.lean(rows)


def keys(bits: int, k: int) -> list:
    """For each choice of k of k + bits blocks: an expression for its number and the bits of these blocks together."""
    edges = [64 * i // (k + bits) for i in range(k + bits + 1)]
    out = []
    choices = list(combinations(range(k + bits), k))
    for number, chosen in enumerate(choices):
        value = F.lit(0).cast("long")
        for c in chosen:
            width = edges[c + 1] - edges[c]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", edges[c]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(value * len(choices) + number)
    return out


def choice(n: int, bits: int, average: int = 1000) -> int:
    """The least k whose buckets hold at most so many of n fingerprints on average."""
    return next((k for k in range(1, 7) if n / 2 ** (64 * k // (k + bits)) <= average and 64 * k // (k + bits) < 56), 3)


def near_links(fps: DataFrame, bits: int = 3, split: int = 20_000, k: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all within ``bits`` differing bits."""
    k = k or choice(fps.count(), bits)
    spread = fps.select("fp", F.explode(F.array(*keys(bits, k))).alias("k1"))
    hot = spread.groupBy("k1").count().where(F.col("count") > split).select("k1", F.ceil(F.col("count") / split).cast("int").alias("parts"))
    hot = stash(hot, "hot")
    placed = spread.join(small(hot), "k1", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), "parts")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j.cast("long")) * 1_000_000 + F.greatest(part, j.cast("long")))
    dealt = placed.select("k1", F.explode(pairs).alias("k2"), "fp").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(forest_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fps = stash(fingerprints(own(docs, doc_id, text).toDF("doc_id", "text"), carry=["doc_id"], shingle=shingle), "prints")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    links = stash(near_links(nodes, bits), "links")
    member = stash(components(links), "members")
    # few fingerprints have links: their components' smallest ids are found apart
    linked = nodes.join(member, nodes.fp == member.node).select("fp", "root", "low")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    known = stash(nodes.join(linked.join(low, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
    release(nodes, links, member)
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: that with its smallest id; of rows with equal ids any one stays, rows without ids all do."""
    flat, doc_id, text = numbered(docs, doc_id, text)
    keep = near_duplicates(flat, doc_id=doc_id, text=text, **options).where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    kept = flat.join(keep, doc_id).select(*flat.columns).dropDuplicates([doc_id])
    return kept.unionByName(flat.where(F.col(doc_id).isNull())).toDF(*docs.columns)


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
