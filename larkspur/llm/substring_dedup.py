"""Substring dedup by seed and extend: repeated passages of at least ``length`` words go, but for their first place.

Seeds are runs of ``seed`` words. Winnowing takes, in every window of ``length`` words, the seed with the least hash
(the leftmost of equals), so equal windows take equal seeds at equal offsets. An anchor is a seed that some windows
took, with its extent: the words of all these windows. Anchors are joined on (seed, extent): all but the first place
of an extent repeat it whole, to both sides. Where one seed stands in several extents, the extents agree only in part;
for one place of each of them the match is extended word by word to both sides, as hashes of the single windows.
Overlapping repeated windows add up to maximal repeats. A window belongs to one anchor, so nothing is compared twice
and no pairs within a group are made: first places come from partial aggregation, and the joins back are plain
shuffled joins that AQE splits where one key is frequent.

A window is known by 128 bits (its seed's and its own hash).

Defined results: null texts have no words; texts shorter than ``length`` words keep all of them; rows with equal ids
share their places, so give rows ids of their own; a text whose id is null keeps all its words, and others repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import own, release, stash

LENGTH, SEED = 20, 8


def winnow(h: np.ndarray, first: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first window, last window) of each anchor, as indexes of words; first: where documents begin."""
    n = np.diff(first)
    count = np.maximum(n - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    if not len(start):
        return doc, start, start, start
    at = np.arange(max(len(h) - seed + 1, 0))
    seeds = tv.Runs(h).of(at, at + seed)
    w = length - seed + 1
    # the least of each w seeds, leftmost first, by doubling
    least, place, span = seeds, at, 1
    while span < w:
        step = min(span, w - span)
        right = least[step:] < least[: len(least) - step]
        least, place = np.where(right, least[step:], least[: len(least) - step]), np.where(right, place[step:], place[: len(place) - step])
        span += step
    anchor = place[start]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(anchor)) - 1
    return doc[head], anchor[head], start[head], start[tail]


def anchors(length: int, seed: int):
    """The function for mapInArrow: (doc_id, text) in, anchors out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in tv.chunks(batch, "text"):
                starts, ends, first = tv.spans(data, off, tv.PLAIN)
                h = tv.word_hashes(data, starts, ends)
                doc, at, low, high = winnow(h, first, length, seed)
                runs = tv.Runs(h)
                extent = tv.mix(runs.of(low, high + length) ^ ((at - low) << 32 | (high - low)).astype(np.uint64))
                yield pa.record_batch(
                    [
                        pa.array(runs.of(at, at + seed).view(np.int64)), pa.array(extent.view(np.int64)), part.column(0).take(pa.array(doc)),
                        pa.array(low - first[doc]), pa.array((high - low).astype(np.int32)),
                    ],
                    names=["seed", "extent", "doc_id", "low", "more"],
                )

    return tv.lean(rows)


def windows(length: int, seed: int):
    """The function for mapInArrow: (doc_id, text, lows) in, each window of the anchors whose first windows are lows out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in tv.chunks(batch, "text"):
                starts, ends, first = tv.spans(data, off, tv.PLAIN)
                h = tv.word_hashes(data, starts, ends)
                doc, at, low, high = winnow(h, first, length, seed)
                lows = part.column(2)
                places = lows.offsets.to_numpy().astype(np.int64)
                places -= places[0]
                wanted = np.repeat(first[:-1], np.diff(places)) + lows.flatten().to_numpy(zero_copy_only=False)
                took = np.isin(low, wanted)
                doc, at, low, high = doc[took], at[took], low[took], high[took]
                n = high - low + 1
                anchor = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n) + low[anchor]
                runs = tv.Runs(h)
                k = doc[anchor]
                yield pa.record_batch(
                    [pa.array(runs.of(at, at + seed)[anchor].view(np.int64)), pa.array(runs.of(start, start + length).view(np.int64)), part.column(0).take(pa.array(k)), pa.array(start - first[k])],
                    names=["seed", "win", "doc_id", "low"],
                )

    return tv.lean(rows)


def cut(length: int, digest: bool):
    """The function for mapInArrow: (doc_id, text, spans) in; what is left of the text out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part, data, off in tv.chunks(batch, "text"):
                starts, ends, first = tv.spans(data, off, tv.PLAIN)
                n, spans = np.diff(first), part.column(2)
                gone = np.zeros(len(starts) + 1, np.int64)
                counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                low, more = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
                low += np.repeat(first[:-1], counts)
                np.add.at(gone, low, 1)
                np.add.at(gone, low + more + length, -1)
                kept = np.cumsum(gone)[:-1] == 0
                texts = []
                sofar = np.concatenate([[0], np.cumsum(kept)])[first]
                pick = np.flatnonzero(kept)
                buf, s, e = data.tobytes(), starts[pick].tolist(), ends[pick].tolist()
                for a, b in zip(sofar[:-1].tolist(), sofar[1:].tolist(), strict=True):
                    text = b" ".join([buf[x:y] for x, y in zip(s[a:b], e[a:b], strict=True)])
                    texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(n - np.diff(sofar), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return tv.lean(rows)


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, low, more): first words of repeated windows and how many windows follow on; docs: (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stash(docs.mapInArrow(anchors(length, seed), f"seed long, extent long, doc_id {kind}, low long, more int"), "anchors")
    place = F.struct("doc_id", "low")
    first = stash(found.groupBy("seed", "extent").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "extents")
    again = first.where("n > 1").select("seed", "extent", "first")
    whole = stash(found.join(again, ["seed", "extent"]).where(F.col("doc_id").isNotNull() & ~(place.eqNullSafe(F.col("first")))).select("doc_id", "low", "more"), "whole")
    release(found)
    # seeds in several extents: extend word by word, for the first place of each extent
    several = first.groupBy("seed").agg(F.count(F.lit(1)).alias("extents")).where("extents > 1").select("seed")
    lows = stash(first.join(several, "seed", "left_semi").select("first.doc_id", "first.low").where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("low").alias("lows")), "lows")
    # texts without ids are told apart by their own hashes, and all their places are extended: none of them is removed
    nameless = docs.where("doc_id is null").select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    theirs = nameless.mapInArrow(anchors(length, seed), "seed long, extent long, doc_id long, low long, more int").join(several, "seed", "left_semi")
    theirs = nameless.join(theirs.groupBy("doc_id").agg(F.collect_list("low").alias("lows")), "doc_id").select("doc_id", "text", "lows")
    theirs = theirs.mapInArrow(windows(length, seed), "seed long, win long, doc_id long, low long").select("seed", "win", F.lit(None).cast(kind).alias("doc_id"), "low")
    named = docs.join(lows, "doc_id").select("doc_id", "text", "lows").mapInArrow(windows(length, seed), f"seed long, win long, doc_id {kind}, low long")
    single = stash(named.unionByName(theirs), "windows")
    release(first, lows)
    least = stash(single.groupBy("seed", "win").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", "win", "first"), "firsts")
    part = stash(single.join(least, ["seed", "win"]).where(F.col("doc_id").isNotNull() & ~(place.eqNullSafe(F.col("first")))).select("doc_id", "low", F.lit(0).alias("more")), "part")
    release(single, least)
    return whole.unionByName(part)


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (their sha256 if digest), for every document."""
    docs = own(docs, doc_id, text).toDF("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length, seed)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("low", "more")).alias("spans"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(cut(length, digest), f"doc_id {kind}, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


def brute(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept text) by looking at every window, for tests."""
    import re

    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            if x in seen:
                gone.update(range(k, k + length))
            seen.add(x)
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out
