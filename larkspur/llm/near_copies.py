"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash. A set has a fingerprint of 576 bits: a bit is 1 if it is set in over half the hashes of
its different shingles, so two sets of similarity s and equal size differ in each with probability
acos(2s / (1 + s)) / pi: 0.151 at 0.8, 0.5 for strangers. Three of the nine words are the print that is compared: near prints
differ in at most ``RADIUS`` of 192 bits, and in at most ``FIRST`` of the first 64. The bits of the other six, some
``width`` of them chosen for each of many keys, name the buckets in which prints meet. ``width`` grows with the number
of sets, so that an average bucket holds at most ``AVERAGE``, and the number of keys with it, so that at similarity 0.8
the probability to share no bucket stays at most ``MISS`` (``plan``); ``ROUND`` keys are dealt out at a time. In a
bucket the prints lie in Gray order under a tree that is joined with itself, as in simhash; prints
near one leader are linked to it and not compared with each other (``stars``), so a large group of near copies does not
cost its square. Links go to large-star/small-star.

Every component of near prints is then taken apart on the sets themselves: a task holds its members and goes breadth
first from each to those not reached yet, so it compares all that could still connect and its output is linear in its
input. Components of more than ``split`` shingles are dealt out as pairs of parts. Documents with equal sets are one
node from the start.

Defined results: ASCII capitals count as small letters; with fewer words than a shingle the whole sequence is the only
shingle; null and empty texts have equal, empty sets; a null id never is a component's id unless all ids of the
component are null; near_copies() keeps repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, lgamma, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import numbered, own, release, small, stash
from .components import components
from .simhash import FAN, Forest, gray_rank, groups, spanning, whole_buckets

SHINGLE = 5
SPLIT = 4_000_000
#: Words of 64 bits: those of the print, and those that name buckets.
PRINT, NAMING = 3, 6
RADIUS, FIRST = 56, 27
AVERAGE, MISS = 100, 3e-5
ROUND = 32
BUCKET = 20_000
LEADERS = 4
#: The columns of a print.
P = [f"p{i}" for i in range(PRINT)]
#: What each word of a fingerprint adds to the hashes of shingles.
TURN = tv.mix(np.arange(1, PRINT + NAMING + 1, dtype=np.uint64) * np.uint64(tv.BASE))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, a hash of each row's set, its size, the sets' sorted hashes one after another)."""
    for batch in batches:
        for part, data, off in tv.chunks(batch, "text", tv.CHUNK // 2):
            data = tv.FOLD[data]
            starts, ends, first = tv.spans(data, off, tv.PLAIN)
            n = np.diff(first)
            count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
            row = np.repeat(np.arange(len(n)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            runs = tv.Runs(tv.word_hashes(data, starts, ends)).of(at, at + np.minimum(n[row], SHINGLE))
            runs = runs[np.lexsort((runs, row))]
            new = np.ones(len(runs), bool)
            new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
            runs = runs[new]
            size = np.bincount(row[new], minlength=len(n))
            full = np.flatnonzero(size)
            same = np.zeros(len(n), np.uint64)
            if len(full):
                same[full] = tv.mix(np.add.reduceat(tv.mix(runs), (np.cumsum(size) - size)[full]) + size[full].astype(np.uint64))
            yield part, same, size, runs


def majority(runs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprints (rows of 9 words) of sets of so many hashes, lying one after another; zero for empty sets."""
    full = np.flatnonzero(size)
    out = np.zeros((len(size), len(TURN)), np.uint64)
    if not len(full):
        return out
    # sums of up to 255 bits fit in one byte, so eight of them are added at once
    pieces = -(-size[full] // 255)
    first = np.cumsum(pieces) - pieces
    heads = np.repeat((np.cumsum(size) - size)[full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for j, turn in enumerate(TURN):
        bits = np.unpackbits(tv.mix(runs + turn).astype("<u8").view(np.uint8), bitorder="little")
        sums = np.add.reduceat(bits.view(np.uint64).reshape(-1, 8), heads, axis=0).view(np.uint8).reshape(-1, 64)
        sums = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        out[full, j] = np.packbits(2 * sums > size[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, text) in; doc_id, the set's hash and size, the words of its print and the others out."""
    for part, same, size, runs in hashed(batches):
        words = majority(runs, size).view(np.int64)
        naming = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * NAMING), pa.array(words[:, PRINT:].reshape(-1)))
        yield pa.record_batch([part.column(0), pa.array(same.view(np.int64)), pa.array(size.astype(np.int64)), *(pa.array(words[:, i].copy()) for i in range(PRINT)), naming], names=["doc_id", "same", "size", *P, "naming"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, text) in; the set's hash and its sorted hashes out."""
    for part, same, size, runs in hashed(batches):
        held = pa.py_buffer(np.concatenate([[0], np.cumsum(size) * 8]).astype(np.int32))
        yield pa.record_batch([pa.array(same.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(size), [None, held, pa.py_buffer(runs)])], names=["same", "shingles"])


def plan(n: int) -> tuple[int, int]:
    """For n sets: the bits of a key, and the keys needed for MISS at similarity 0.8."""
    width = max(4, ceil(log2(max(n, 1) / AVERAGE)))
    bits, p = 64 * NAMING, acos(8 / 9) / pi
    d = np.arange(bits + 1)
    chance = np.exp([lgamma(bits + 1) - lgamma(x + 1) - lgamma(bits - x + 1) + x * log(p) + (bits - x) * log(1 - p) for x in d])
    apart = 1 - (1 - d / bits) ** width  # for one key of bits chosen at random, when d of all differ
    low, high = 0, 1
    while (chance * apart**high).sum() > MISS:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if (chance * apart**mid).sum() > MISS else (low, mid)
    return width, high


def named(chosen: np.ndarray):
    """The function for mapInArrow: a print and its other words in, a row (k1, print) for each key out; a line of chosen has the bits of a key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(PRINT).flatten().to_numpy().view(np.uint64).reshape(-1, NAMING).T.copy()
            for number, bits in enumerate(chosen.tolist()):
                key = np.full(len(batch), number, np.uint64)
                for bit in bits:
                    key = key << np.uint64(1) | words[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)
                yield pa.record_batch([pa.array(key.view(np.int64)), *batch.columns[:PRINT]], names=["k1", *P])

    return tv.lean(rows)


def differing(x: np.ndarray) -> np.ndarray:
    """The number of bits set in each row of words."""
    return sum(np.bitwise_count(x[:, i]) for i in range(PRINT))


def stars(group: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """For each row the place of a leader of its group that it is near to, or -1; a group's first free row leads, LEADERS times."""
    leader = np.full(len(group), -1)
    for _ in range(LEADERS):
        free = np.flatnonzero(leader < 0)
        if not len(free):
            break
        first = np.flatnonzero(np.concatenate([[True], group[free][1:] != group[free][:-1]]))
        lead = np.repeat(free[first], np.diff(np.append(first, len(free))))
        near = differing(fp[free] ^ fp[lead]) <= bits
        leader[free[near]] = lead[near]
    return leader


class Stars(Forest):
    """A tree over prints that does not compare what has one leader."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, bits: int):
        leader = stars(group, fp, bits)
        order = np.lexsort((gray_rank(fp[:, 0]), leader, group))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.fp, group, leader = fp[order], group[order], leader[order]
        self.first = self.fp[:, 0].copy()
        rows = np.flatnonzero(leader >= 0)
        self.led = place[leader[rows]], rows
        self.levels = [(np.arange(len(order)), None, np.arange(len(order) + 1))]  # only the length of the first is used
        self.shared = [(None, self.fp, leader)]  # mask, pattern, the leader of all rows below
        ones, zeros, least, most = self.fp, self.fp, leader, leader
        while True:
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            if len(first) == len(group):
                break
            index = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            head = np.flatnonzero(index % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, head), np.bitwise_or.reduceat(zeros, head)
            least, most, group = np.minimum.reduceat(least, head), np.maximum.reduceat(most, head), group[head]
            self.levels.append((head, None, np.append(head, len(index))))
            self.shared.append((~(ones ^ zeros), ones, np.where(least == most, least, -1)))

    def near(self, level: int, p: np.ndarray, q: np.ndarray, bits: int) -> np.ndarray:
        mask, pattern, leader = self.shared[level]
        if level:
            return (differing((pattern[p] ^ pattern[q]) & mask[p] & mask[q]) <= bits) & ((leader[p] != leader[q]) | (leader[p] < 0))
        out = np.bitwise_count(self.first[p] ^ self.first[q]) <= FIRST
        some = np.flatnonzero(out)
        p, q = p[some], q[some]
        out[some] = (differing(pattern[p] ^ pattern[q]) <= bits) & ((leader[p] != leader[q]) | (leader[p] < 0))
        return out


def print_links(bits: int):
    """The function for mapInArrow: rows (k1, k2, print) in order of buckets in, links (a, b: two prints) that span their links out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k1, k2, *fp in whole_buckets(batches, 2 + PRINT):
            tree = Stars(groups(k1, k2), np.stack(fp, axis=1).view(np.uint64), bits)

            def both(tree: Stars = tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                yield tree.led
                yield from tree.links(bits)

            a, b = (tree.fp[x].view(np.int64) for x in spanning(both(), len(tree.fp)))
            if len(a):
                yield pa.record_batch([pa.array(x[:, i].copy()) for x in (a, b) for i in range(PRINT)], names=[x + c for x in "ab" for c in P])

    return tv.lean(rows)


def near_prints(made: DataFrame, split: int = BUCKET) -> list[DataFrame]:
    """Tables (a, b): links between hashes of prints that connect all near ones that share a bucket; made: a print and its other words."""
    n = made.count()
    width, count = plan(n)
    chosen = np.random.default_rng(8).integers(0, 64 * NAMING, (count, width))
    schema = ", ".join(f"{c} long" for c in ("k1", *P))
    out = []
    for i in range(0, count, ROUND):
        bits = chosen[i : i + ROUND]
        placed = made.mapInArrow(named(bits), schema).withColumn("parts", F.lit(1))
        if n > split:  # one print in sixteen tells which buckets are large; that decides on parts, not on results
            some = made.where(F.pmod(F.xxhash64(*P), F.lit(16)) == 0).mapInArrow(named(bits), schema).groupBy("k1").count()
            hot = stash(some.where(F.col("count") * 16 > split).select("k1", F.ceil(F.col("count") * 16 / split).cast("int").alias("parts")), "hot")
            if hot.limit(1).count():
                placed = placed.drop("parts").join(small(hot), "k1", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = _parts(placed, F.xxhash64(*reversed(P))).select("k1", "k2", *P).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
        links = dealt.mapInArrow(print_links(RADIUS), ", ".join(f"{x}{c} long" for x in "ab" for c in P))
        out.append(stash(links.select(*(F.xxhash64(*(x + c for c in P)).alias(x) for x in "ab")), "near"))
    return out


def _parts(rows: DataFrame, by) -> DataFrame:
    """Rows with k2: one row for each pair of parts (column parts) that a row's part belongs to."""
    part = F.pmod(by, "parts")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j.cast("long")) * 1_000_000 + F.greatest(part, j.cast("long")))
    return rows.withColumn("k2", F.explode(pairs))


def forest(members: list[bytes]) -> list[tuple[int, int]]:
    """Links (places of members) that connect all sets of similarity 0.8 or more."""
    size = np.array([len(x) // 8 for x in members])
    ids = np.unique(np.frombuffer(b"".join(members), np.uint64), return_inverse=True)[1].reshape(-1)
    mine = np.split(ids, np.cumsum(size)[:-1])
    mark = np.zeros(len(ids), bool)
    left, out = np.arange(len(members)), []
    while len(left) > 1:
        queue, left, others = [left[0]], left[1:], None
        while queue and len(left):
            if others is None:
                others, begin = np.concatenate([mine[i] for i in left]), np.cumsum(size[left]) - size[left]
            a = queue.pop()
            mark[mine[a]] = True
            both = np.add.reduceat(mark[others], begin, dtype=np.int64)
            mark[mine[a]] = False
            near = 9 * both >= 4 * (size[a] + size[left])  # both / (sum of sizes - both) >= 4 / 5
            if near.any():
                out += [(a, b) for b in left[near]]
                queue += left[near].tolist()
                left, others = left[~near], None
    return out


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (k1, k2, same, shingles) sorted by bucket in, links (a, b) out."""
    now, same, held = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        found = forest(held) if len(held) > 1 else []
        if found:
            yield pa.record_batch([pa.array([same[x] for x, _ in found], pa.int64()), pa.array([same[y] for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for k1, k2, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) != now:
                yield from links()
                now, same, held = (k1, k2), [], []
            same.append(node)
            held.append(shingles)
    yield from links()


PRINTS = ", ".join(["same long, size long", *(f"{c} long" for c in P), "naming array<long>"])


def copy_links(docs: DataFrame, made: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): confirmed links between hashes of sets (column same); shingles are made for those in one component of near prints."""
    nodes = stash(made.where("size > 0").dropDuplicates(["same"]).select("same", "size", F.xxhash64(*P).alias("fp"), *P, "naming"), "sets")
    near = near_prints(nodes.select(*P, "naming"))
    member = stash(components(reduce(DataFrame.unionByName, near)), "near_members")
    # a component's id is one of its prints, so prints without links stay apart
    placed = nodes.join(member, nodes.fp == member.node, "left").select("same", "size", F.coalesce("root", "fp").alias("k1"))
    placed = stash(placed, "placed")
    told = placed.groupBy("k1").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    told = stash(told.select("k1", F.ceil(F.col("total") / split).cast("int").alias("parts")), "told")
    dealt = stash(_parts(placed.join(small(told), "k1"), F.xxhash64("same")).select("k1", "k2", "same"), "dealt")
    wanted = small(stash(dealt.select("same").distinct(), "wanted"))
    shingles = docs.mapInArrow(tv.lean(sets), "same long, shingles binary")
    shingles = stash(shingles.join(wanted, "same", "left_semi").dropDuplicates(["same"]), "shingles")
    whole = dealt.join(shingles, "same").select("k1", "k2", "same", "shingles").repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    links = stash(whole.mapInArrow(tv.lean(confirm), "a long, b long"), "links")
    release(nodes, *near, member, placed, told, dealt, shingles)
    return links


def _components(docs: DataFrame, split: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same) of every row, and (same, component_id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = stash(docs.mapInArrow(tv.lean(prints), f"doc_id {kind}, {PRINTS}"), "prints")
    rows = stash(made.select("doc_id", "same"), "rows")
    nodes = stash(rows.groupBy("same").agg(F.min("doc_id").alias("low")), "nodes")
    links = copy_links(docs, made, split)
    member = stash(components(links), "members")
    release(made, links)
    linked = nodes.join(member, nodes.same == member.node).select("same", "root", "low")
    low = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    known = nodes.join(linked.join(low, "root").select("same", "component_id"), "same", "left").select("same", F.coalesce("component_id", "low").alias("component_id"))
    known = stash(known, "components")
    release(nodes, member)
    return rows, known


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """doc_id, component_id for every row of docs."""
    rows, known = _components(own(docs, doc_id, text).toDF("doc_id", "text"), split)
    return rows.join(known, "same").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """One row of each component: that with its smallest id, rows without ids last; of equal ids that with the least hash of its text, then of its other columns."""
    flat, doc_id, text = numbered(docs, doc_id, text)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    rows, known = _components(flat.select(order.alias("doc_id"), F.col(text).alias("text")), split)
    keep = known.select(F.col("component_id").alias("_first")).distinct()
    kept = flat.withColumn("_order", order).join(keep, F.col("_order") == F.col("_first"))
    # rows with this id and text; the others' hashes decide between them
    rest = F.xxhash64(*[f.name for f in flat.schema if f.dataType.typeName() not in ("map", "variant")])
    first = kept.withColumn("_rest", rest).groupBy("_first").agg(F.min_by(F.struct(*flat.columns), "_rest").alias("_row"))
    return first.select("_row.*").toDF(*docs.columns)
