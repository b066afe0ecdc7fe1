"""Benchmark decontamination by suffix arrays over the training words.

Each chunk of documents is a shard: the suffixes that begin like some benchmark suffix are sorted by their words
into a suffix array, every benchmark suffix is binary-searched in it, and the hits give verbatim matches with their
places. Nothing is shuffled. The benchmark is a stated query set: it travels to the executors in blocks of about
``block_words`` words, at most ``GROUP`` blocks at a time, and every document is held against every block. Documents
are read once for each group of blocks; between groups they are written with what has been found so far, so neither a
broadcast nor a worker grows with the benchmark. Suffixes are cut at ``width`` words, since a window is no longer, and
an array lives as long as its chunk; places of longer matches come from windows that follow each other.

Defined results: a null text has no words; an item without words matches nothing; an item with fewer than ``width``
words is one window as long as itself; a null item id marks words but is not listed; equal item ids count once;
repeated rows give repeated rows; tables without rows give none; a new column whose name docs already has gets an underscore after its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import free_names, numbered, own, stash

WIDTH, GROUP = 13, 4
ADDED = ("n_words", "n_hit", "items", "matches", "hits")
RESULT = ("long", "long", "array<string>", "array<struct<item_id:string,item_start:int,doc_start:long,n_words:int>>", "array<struct<low:long,high:long>>")
ARROW = (pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int64()), ("n_words", pa.int32())])), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))


class Block:
    """Windows of some benchmark items, as sorted keys over their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        texts = pa.record_batch({"text": pa.array([t for _, t in items], pa.string())})
        hashes, firsts, n = [], [], 0
        for _, data, off in tv.chunks(texts, "text"):
            data = tv.FOLD[data]
            starts, ends, first = tv.spans(data, off, tv.ALNUM)
            hashes.append(tv.word_hashes(data, starts, ends))
            firsts.append(first[:-1] + n)
            n += len(starts)
        h = np.concatenate([*hashes, np.empty(0, np.uint64)])
        first = np.concatenate([*firsts, [n]]).astype(np.int64)
        self.width, self.names = width, [i for i, _ in items]
        self.vocabulary = np.unique(h)
        ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.uint32)
        size = np.diff(first)
        count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
        item = np.repeat(np.arange(len(size)), count)
        at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size[item], width)
        keys = suffix_keys(ids, first[item] + at, first[item] + at + length, width)
        self.keys, inverse = np.unique(keys, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.of = np.searchsorted(inverse[order], np.arange(len(self.keys) + 1))  # a key's windows, as a range of:
        self.item, self.at = item[order], at[order]
        self.length = np.zeros(len(self.keys), np.int64)
        self.length[inverse] = length
        self.depth = int(min(3, self.length.min())) if len(self.keys) else 0
        begin = first[item] + at
        self.heads = [np.unique(self.head(ids, begin, d)) for d in range(1, self.depth + 1)]

    def head(self, ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """One number for the first words at each place."""
        out = np.zeros(len(at), np.uint64)
        for d in range(depth):
            out = out * np.uint64(len(self.vocabulary) + 1) + ids[at + d]
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary's ids, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.uint32)
        k = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == h, k + 1, 0).astype(np.uint32)


def suffix_keys(ids: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The words from start to end, at most width of them, as byte strings that sort like the words."""
    held = np.concatenate([ids, np.zeros(width, np.uint32)])
    out = np.empty((len(start), width), ">u4")
    for d in range(width):
        out[:, d] = np.where(start + d < end, held[start + d], 0)
    return out.reshape(-1).view(f"S{4 * width}") if len(start) else np.empty(0, f"S{4 * width}")


def search(block: Block, ids: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every occurrence of the block's windows among ids; stop is where each word's document ends."""
    none = np.empty(0, np.int64)
    if not len(block.keys) or not len(ids):
        return none, none
    at = np.flatnonzero(ids)
    for d, known in enumerate(block.heads, 1):
        at = at[at + d <= stop[at]]
        at = at[ids[at + d - 1] > 0] if len(at) else at
        head = block.head(ids, at, d)
        k = np.minimum(np.searchsorted(known, head), len(known) - 1)
        at = at[known[k] == head]
    if not len(at):
        return none, none
    suffixes = suffix_keys(ids, at, stop[at], block.width)
    order = np.argsort(suffixes, kind="stable")
    array, places = suffixes[order], at[order]
    low = np.searchsorted(array, block.keys, "left")
    padded = np.frombuffer(block.keys.tobytes(), np.uint8).reshape(len(block.keys), -1).copy()
    padded[np.arange(padded.shape[1]) >= 4 * block.length[:, None]] = 255
    high = np.searchsorted(array, padded.reshape(-1).view(array.dtype), "right")
    found = high - low
    key = np.repeat(np.arange(len(low)), found)
    rank = np.arange(len(key)) - np.repeat(np.cumsum(found) - found, found) + low[key]
    return places[rank], key


def longest(block: Block, place: np.ndarray, key: np.ndarray, stop: np.ndarray) -> list[tuple]:
    """Windows that follow each other on one diagonal of item and document, joined: (item, start, place, words)."""
    count = block.of[key + 1] - block.of[key]
    place, length = np.repeat(place, count), np.repeat(block.length[key], count)
    at = np.repeat(block.of[key], count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    item, start = block.item[at], block.at[at]
    order = np.lexsort((place, place - start, stop[place] if len(place) else place, item))
    item, start, place, length = item[order], start[order], place[order], length[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (start[1:] != start[:-1] + 1) | (stop[place[1:]] != stop[place[:-1]])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(item)))
    return list(zip(item[first].tolist(), start[first].tolist(), place[first].tolist(), (length[first] + run - 1).tolist(), strict=True))


def matcher(blocks: list, width: int, text: str, places: bool, carry: list[str], sofar: bool, more: bool):
    """The function for mapInArrow: blocks are broadcast lists of items, carry names the columns that go on.

    sofar: rows have the ADDED columns of the blocks before, with hits, the ranges of hit words; more: hits go on.
    """
    built: list[Block] = []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.extend(Block(b.value, width) for b in blocks)
        for batch in batches:
            for part, data, off in tv.chunks(batch, text):
                data = tv.FOLD[data]
                starts, ends, first = tv.spans(data, off, tv.ALNUM)
                h, n = tv.word_hashes(data, starts, ends), np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                stop = np.repeat(first[1:], n)
                covered, items, matches = np.zeros(len(h) + 1, np.int64), {}, {}
                if sofar:
                    for k, (held, found, spans) in enumerate(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ADDED[2:]), strict=True)):
                        items[k], matches[k] = set(held), list(found)
                        for x in spans:
                            covered[first[k] + x["low"]] += 1
                            covered[first[k] + x["high"]] -= 1
                for block in built:
                    place, key = search(block, block.ids(h), stop)
                    np.add.at(covered, place, 1)
                    np.add.at(covered, place + block.length[key], -1)
                    for d, k in np.unique(np.stack([doc[place], key], 1), axis=0).tolist():
                        items.setdefault(d, set()).update(x for i in block.item[block.of[k] : block.of[k + 1]] if (x := block.names[i]) is not None)
                    if places:
                        for i, s, p, m in longest(block, place, key, stop):
                            matches.setdefault(int(doc[p]), []).append({"item_id": block.names[i], "item_start": s, "doc_start": int(p - first[doc[p]]), "n_words": m})
                inside = np.cumsum(covered)[:-1] > 0
                hit = np.concatenate([[0], np.cumsum(inside)])
                out = [pa.array(n, pa.int64()), pa.array(hit[first[1:]] - hit[first[:-1]], pa.int64())]
                found = [[sorted(items.get(i, ())) for i in range(len(n))], [matches.get(i, []) for i in range(len(n))]]
                if more:
                    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
                    edge[first[1:-1]] = 0  # ranges end where their document does
                    low = np.union1d(np.flatnonzero(edge[:-1] > 0), first[:-1][n > 0][inside[first[:-1][n > 0]]])
                    high = np.union1d(np.flatnonzero(edge < 0), first[1:][n > 0][inside[first[1:][n > 0] - 1]])
                    ranges: dict = {}
                    for x, y in zip(low.tolist(), high.tolist(), strict=True):
                        ranges.setdefault(int(doc[x]), []).append({"low": x - int(first[doc[x]]), "high": y - int(first[doc[x]])})
                    found.append([ranges.get(i, []) for i in range(len(n))])
                yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in carry), *out, *(pa.array(x, t) for x, t in zip(found, ARROW))], names=[*carry, *ADDED[: 4 + more]])

    return tv.lean(rows)


def find_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = 1_000_000, places: bool = True, carry: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and matches (longest verbatim runs, if places).

    carry: the columns of docs that are returned (all).
    """
    spark, names = docs.sparkSession, docs.columns if carry is None else carry
    now, text, *carried = numbered(docs, text, *names)
    now = now.select(*dict.fromkeys([*carried, text]))
    kinds = {f.name: f.dataType.simpleString() for f in now.schema}
    items = own(benchmark, item_id, item_text).toDF("item_id", "text").where("text is not null").select(F.col("item_id").cast("string"), "text")

    def groups() -> Iterator[list]:
        blocks, block, held = [], [], 0
        for name, content in items.toLocalIterator():
            block.append((name, content))
            held += len(content) // 2 + 1
            if held > block_words:
                blocks.append(block)
                block, held = [], 0
                if len(blocks) == GROUP:
                    yield blocks
                    blocks = []
        yield [*blocks, block]

    sofar, told = False, None
    for blocks in groups():
        if told is not None:
            now, sofar = stash(search_group(now, told, width, text, places, kinds, sofar, True), "found"), True
        told = [spark.sparkContext.broadcast(b) for b in blocks]
    found = search_group(now, told, width, text, places, {c: kinds[c] for c in carried}, sofar, False)
    return found.toDF(*names, *free_names(list(names), list(ADDED[:4])))


def search_group(docs: DataFrame, blocks: list, width: int, text: str, places: bool, kinds: dict[str, str], sofar: bool, more: bool) -> DataFrame:
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"{c} {k}" for c, k in zip(ADDED[: 4 + more], RESULT, strict=False))])
    return docs.mapInArrow(matcher(blocks, width, text, places, list(kinds), sofar, more), schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", share: int | None = None, **options) -> DataFrame:
    """docs without those that hold a benchmark window anywhere; with ``share``, only if one word in so many lies in windows.

    An item of fewer than ``width`` words is a window, so a very short item removes every document that has its words in a row.
    """
    flat, text = numbered(docs, text)
    found = find_matches(flat, benchmark, text=text, places=False, **options)
    gone = F.col("n_hit") > 0
    if share is not None:
        gone &= share * F.col("n_hit") >= F.col("n_words")
    return found.where(~gone).select(*flat.columns).toDF(*docs.columns)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "matches",
    )


def brute(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> list[tuple]:
    """The contract's rows by plain search, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if len(x := tuple(w[k : k + n])) == n and x in windows:
                    hit.update(range(k, k + n))
                    names |= windows[x]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
