"""LM scoring by cross-entropy difference: how much better a target model predicts a document than a background model.

Both are interpolated bigram models over one vocabulary, all words of the corpus, told apart by 64-bit hashes: the
target's is counted over the documents marked as such, the background's over all. What is counted grows with the corpus
and stays distributed; nothing but two totals of each model is sent to the driver.

Documents are dealt into blocks of some megabytes of text as they lie. A block lists its distinct words and bigrams
in order of their hashes, with its counts of them, and sends each bucket its part of the list. A bucket has all parts
of its range of hashes; it adds the counts up and answers each part with the sums, in the order of its list. A block
with its answers then scores its documents. So whatever the corpus and however frequent a word, a block sends and gets
one number for each distinct word and bigram it holds, and a task holds one block or one bucket. There are as many
buckets as blocks of the least size, up to ``BUCKETS``; blocks grow with the corpus, up to ``MOST_BLOCK`` bytes, so that
parts do not become too short.

Defined results: ASCII capitals count as small letters; a null or empty text has no tokens and null losses; without
target documents the target model is uniform; repeated rows count again and score alike; documents with null ids count
for the background and are scored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from . import textvec as tv
from .common import own, release_shuffles, small, stash

START = np.uint64(0x5851F42D4C957F2D)
TRUST = 20.0  # tokens' worth of the unigram model in each bigram context
BLOCK, MOST_BLOCK = 8 << 20, 64 << 20  # least and most bytes of text in a block
BLOCKS, BUCKETS = 1 << 16, 1 << 20  # blocks grow beyond so many; at most so many buckets
PAIR = np.uint64(0x2545F4914F6CDD1D)  # keeps bigrams apart from words


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's hash, hash of the word before or START, index of each row's first word)."""
    data = tv.FOLD[data]
    starts, ends, first = tv.spans(data, off, tv.PLAIN)
    h = tv.word_hashes(data, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][np.diff(first) > 0]] = START
    return h, before, first


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tv.mix(before * np.uint64(3) + word) ^ PAIR


def totals(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct keys and the sums of the values of each."""
    u, at = np.unique(keys, return_inverse=True)
    return u, *[np.bincount(at.reshape(-1), v, len(u)) for v in values]


def blocked(most: int):
    """The function for mapInArrow: (doc_id, text, target) in; the same with the row's block and its place in it in front."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block, size, n = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for part, data, _ in tv.chunks(batch, "text", min(most, tv.CHUNK)):
                if size and size + len(data) > most:
                    block, size, n = block + 1, 0, 0
                size += len(data)
                yield pa.record_batch([pa.array(np.full(len(part), task << 32 | block, np.int64)), pa.array(np.arange(n, n + len(part))), *part.columns], names=["block", "at", *part.schema.names])
                n += len(part)

    return tv.lean(rows)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "block") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(block, its rows) again and again, from rows that are in order of blocks."""

    def runs() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            if len(batch):
                number = batch.column(batch.schema.get_field_index(column)).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(batch)]
                yield from ((int(number[a]), batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    for block, held in itertools.groupby(runs(), key=lambda x: x[0]):
        yield block, [x for _, x in held]


def texts(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of a block's rows."""
    word, before, counts = [], [], []
    for batch in rows:
        for _, data, off in tv.chunks(batch, "text"):
            w, b, first = tokens(data, off)
            word.append(w)
            before.append(b)
            counts.append(np.diff(first))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))])
    return *(np.concatenate([np.empty(0, np.uint64), *x]) for x in (word, before)), first


def counted(word: np.ndarray, before: np.ndarray, first: np.ndarray, target: np.ndarray) -> list[tuple]:
    """(hashes, target counts, background counts) of words and of bigrams, in order of hashes."""
    weight = np.repeat(target, np.diff(first)).astype(float)
    return [totals(keys, weight, np.ones(len(keys))) for keys in (word, pairs(before, word))]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so that the keys of a sorted list come bucket by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the bytes a step takes, the first key, and the steps."""
    steps = np.diff(keys)
    width = -(-int(steps.max()).bit_length() // 8) if len(steps) else 0
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(held: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(held, np.uint8, 8, 1)
    if n > 1:
        out[1:, : held[0]] = np.frombuffer(held, np.uint8, offset=9).reshape(n - 1, held[0])
    return np.cumsum(out.view(np.uint64)[:, 0], dtype=np.uint64)


def count(buckets: int):
    """The function for mapInArrow: rows of blocks in; parts of their lists out.

    Where a reader splits a block, its pieces are told apart by the place of their first rows.
    """
    names = ["bucket", "pair", "block", "start", "grams", "t", "b"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in blocks(batches):
            start = min(x.column(x.schema.get_field_index("at"))[0].as_py() for x in held)
            word, before, first = texts(held)
            target = np.concatenate([x.column(x.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool) for x in held])
            if not len(word):
                continue
            out = []
            for pair, (gram, *seen) in enumerate(counted(word, before, first, target)):
                bucket = bucket_of(gram, buckets)
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(gram)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((int(bucket[i]), bool(pair), block, start, packed(gram[i:j]), *(x[i:j].astype(np.uint32).tobytes() for x in seen)))
            for i in range(0, len(out), 4096):
                yield pa.record_batch([pa.array(x) for x in zip(*out[i : i + 4096], strict=True)], names=names)

    return tv.lean(rows)


PARTS = "bucket long, pair boolean, block long, start long, grams binary, t binary, b binary"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: parts in order of buckets and kinds in; each part answered with the sums of its grams out.

    A row without a block has a bucket's totals: distinct words and their counts.
    """
    names = ["bucket", "pair", "block", "start", "t", "b", "n", "sum_t", "sum_b"]
    held, now, size = [], None, 0

    def answered() -> Iterator[pa.RecordBatch]:
        sizes = [len(x[5]) // 4 for x in held]
        gram = np.concatenate([unpacked(x[4], n) for x, n in zip(held, sizes, strict=True)])
        u, at = np.unique(gram, return_inverse=True)
        at = at.reshape(-1)
        sums = [np.bincount(at, np.frombuffer(b"".join(x[k] for x in held), np.uint32), len(u)).astype(np.int64) for k in (5, 6)]
        bucket, pair = now
        if not pair:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((bucket, pair, None, None, None, None, len(u), int(sums[0].sum()), int(sums[1].sum())), TYPES, strict=True)], names=names)
        cuts = np.cumsum([0, *sizes]).tolist()
        for i in range(0, len(held), 256):
            some = held[i : i + 256]
            t, b = ([s[at[a:z]].tobytes() for a, z in zip(cuts[i : i + len(some)], cuts[i + 1 : i + 1 + len(some)], strict=True)] for s in sums)
            columns = [[bucket] * len(some), [pair] * len(some), [x[2] for x in some], [x[3] for x in some], t, b, *([None] * len(some) for _ in range(3))]
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, TYPES, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != now:
                if held:
                    yield from answered()
                held, now = [], row[:2]
            held.append(row)
    if held:
        yield from answered()


ANSWERS = "bucket long, pair boolean, block long, start long, t binary, b binary, n long, sum_t long, sum_b long"
TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())


def score(number: list[tuple[int, int]], vocabulary: int):
    """The function for mapInArrow: answers and rows of blocks in, in order of blocks, answers first; losses out."""

    def losses(docs: list[pa.RecordBatch], said: list[list[np.ndarray]]) -> pa.RecordBatch:
        word, before, first = texts(docs)
        n, full = np.diff(first), np.diff(first) > 0
        sums = [np.zeros(len(n)), np.zeros(len(n))]
        if len(word):
            words, w_at = np.unique(word, return_inverse=True)
            _, p_at = np.unique(pairs(before, word), return_inverse=True)
            w_at, p_at = w_at.reshape(-1), p_at.reshape(-1)
            b_at = np.minimum(np.searchsorted(words, before), len(words) - 1)
            begins = np.zeros(len(word), bool)
            begins[first[:-1][full]] = True
            for k, (total, n_docs) in enumerate(number):
                c_word, c_pair = (said[pair][k].astype(float) for pair in (0, 1))
                context = np.where(begins, float(n_docs), c_word[b_at])
                loss = np.log(context + TRUST) - np.log(c_pair[p_at] + TRUST * (c_word[w_at] + 1.0) / (total + vocabulary))
                sums[k][full] = np.add.reduceat(loss, first[:-1][full])
        ids = pa.concat_arrays([d.column(d.schema.get_field_index("doc_id")) for d in docs])
        return pa.record_batch([ids, pa.array(n), *(pa.array(x) for x in sums)], names=["doc_id", "n_tokens", "target", "background"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in blocks(batches):
            table = pa.Table.from_batches(held)
            is_doc = table["kind"].to_numpy() == 1
            docs = table.filter(pa.array(is_doc)).sort_by("at").combine_chunks()
            if not len(docs):
                continue
            answers = table.filter(pa.array(~is_doc))
            start, pair, bucket = (answers[c].to_numpy() for c in ("at", "pair", "bucket"))
            t, b = (answers[c].to_pylist() for c in ("t", "b"))
            order = np.lexsort((bucket, pair, start))
            at, starts = docs["at"].to_numpy(), np.unique(start)
            cuts = [0, *np.searchsorted(at, starts[1:]).tolist(), len(docs)] if len(starts) else [0, len(docs)]
            for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                mine = [k for k in order.tolist() if len(starts) and start[k] == starts[i]]
                said = [[np.frombuffer(b"".join(x[k] for k in mine if bool(pair[k]) == bool(p)), np.int64) for x in (t, b)] for p in (0, 1)]
                piece = docs.slice(low, high - low).to_batches()
                if piece:
                    yield losses(piece, said)

    return tv.lean(rows)


def lm_scores(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and score, their difference: low is target-like.

    target_ids: one column, the ids of the target documents.
    """
    spark, base = docs.sparkSession, own(docs, doc_id, text).toDF("doc_id", "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(size // block_bytes, 1), BUCKETS)
    block_bytes = min(max(block_bytes, size // BLOCKS), max(block_bytes, MOST_BLOCK))
    marked = target_ids.toDF("_target").where("_target is not null").distinct()
    told = base.join(small(marked), F.col("doc_id") == F.col("_target"), "left").select("doc_id", "text", F.col("_target").isNotNull().alias("target"))
    held = stash(told.mapInArrow(blocked(block_bytes), f"block long, at long, doc_id {kind}, text string, target boolean"), "blocks")
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_docs = held.agg(F.count_if(worded & F.col("target")), F.count_if(worded)).first()
    parts = held.select("block", "at", "text", "target").mapInArrow(count(buckets), PARTS)
    answers = stash(parts.repartition("bucket").sortWithinPartitions("bucket", "pair").mapInArrow(tv.lean(meet), ANSWERS), "answers")
    release_shuffles(spark)
    got = answers.where("block is null").agg(F.sum("n"), F.sum("sum_t"), F.sum("sum_b")).first()
    number = [(got[1] or 0, n_docs[0]), (got[2] or 0, n_docs[1])]
    nothing = {"bucket": "long", "pair": "boolean", "t": "binary", "b": "binary"}
    rows = held.select("block", F.lit(1).cast("byte").alias("kind"), "at", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "doc_id", "text")
    told = answers.where("block is not null").select("block", F.lit(0).cast("byte").alias("kind"), F.col("start").alias("at"), *nothing, F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    ready = told.unionByName(rows).repartition("block").sortWithinPartitions("block", "kind")
    scored = ready.mapInArrow(score(number, got[0] or 1), f"doc_id {kind}, n_tokens long, target double, background double")
    each = lambda k: F.when(F.col("n_tokens") > 0, F.col(k) / F.col("n_tokens")).alias(f"{k}_loss")
    return scored.select("doc_id", "n_tokens", each("target"), each("background")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scores(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), good)
