"""Token-ID output: documents as ORC rows of token ids, in ascending order of their ids, with an index to read by.

Rows go to shards by ranges of the document id and are sorted in each; a shard is one ORC file whose integer columns
are run-length encoded, with row indexes and a Bloom filter on doc_id, so that readers take stripes in parallel and
skip those that cannot hold an id. A shard's rows carry their offset in the shard; a manifest has the shards' totals.

The tokenizer splits a text by a fixed pattern and then merges within each piece alone. The same split is made here
on arrays of code points, each different piece of a chunk is encoded once by the library, and ids are gathered.
A text that holds the string of an added token is encoded whole by the library instead.

Defined results: a null text is empty and gives the end id alone; null ids come first; rows with equal ids follow
each other by text; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import own, scratch_path, small

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The endings that the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """Encodes texts piece by piece, with a bounded cache of the pieces' ids.

    The cache is two sorted tables of (key, place in the pool, number of ids, place among the held bytes, number of
    bytes): new pieces enter the small one, which is merged into the large one from time to time, so that a chunk does
    not copy all that is held. Keys are hashes, so the bytes of each piece are compared with those its ids were made
    of; a chunk in which any differ is encoded whole by the library.
    """

    MOST, MOST_BYTES = 1_000_000, 32 << 20
    AT_ONCE = 4096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [str(t) for t in (x.content for x in self.library.get_added_tokens_decoder().values())]
        self.classes = np.full(0x110000, 255, np.uint8)
        self.empty()

    def empty(self) -> None:
        none = (np.empty(0, np.uint64), *(np.empty(0, np.int32) for _ in range(4)))
        self.large, self.fresh = none, none
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.held, self.n_held = np.empty(1 << 16, np.uint8), 0

    def ask(self, points: np.ndarray) -> None:
        """Learn the classes of code points from how the library splits them."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            self.classes[p] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(x + c)) == 1), SPACE)

    def bounds(self, points: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces begin, as the pattern has it: endings, then words, numbers and signs with one space before, then spaces."""
        kind = self.classes[points]
        if (kind == 255).any():
            self.ask(np.unique(points[kind == 255]))
            kind = self.classes[points]
        n = len(points)
        edge = np.ones(n + 1, bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[off] = True
        runs = np.flatnonzero(edge[:n])
        ends = np.append(runs[1:], n)
        closed = np.zeros(n + 1, bool)
        closed[off] = True
        before = ends[(kind[runs] == SPACE) & ~closed[ends]]  # a space run ends here, its text goes on
        edge[before[points[before - 1] == 32]] = False
        edge[before - 1] = True
        quote = runs[(kind[runs] == OTHER) & (points[runs] == 39) & (ends - runs == 1) & ~closed[ends]]
        quote = quote[edge[quote]]  # else a space before it belongs to its piece
        tail = np.zeros(n + 2, np.int64)
        tail[:n] = points
        one, two = tail[quote + 1], tail[quote + 2]
        two = np.where(closed[quote + 2], 0, two)
        for e in ENDINGS:
            found = (one == ord(e[0])) & ((two == ord(e[-1])) | (len(e) == 1))
            edge[quote[found] + 1] = False
            edge[quote[found] + 1 + len(e)] = True
        return np.flatnonzero(edge[:n])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """The other columns of each key's row, -1 and zeros for unknown ones."""
        out = tuple(np.full(len(keys), k, np.int64) for k in (-1, 0, 0, 0))
        for held, *columns in (self.large, self.fresh):
            if len(held):
                k = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                hit = held[k] == keys
                for x, column in zip(out, columns, strict=True):
                    x[hit] = column[k[hit]]
        return out

    def learn(self, keys: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the pieces of sorted new keys and hold their ids and bytes; where the ids are and how many."""
        raw = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        pieces = [x.decode() for x in raw]
        ids = [x.ids for i in range(0, len(pieces), self.AT_ONCE) for x in self.library.encode_batch_fast(pieces[i : i + self.AT_ONCE], add_special_tokens=False)]
        size, long = np.array([len(x) for x in ids], np.int64), ends - starts
        at, spot = self.used + np.cumsum(size) - size, self.n_held + np.cumsum(long) - long
        self.used += int(size.sum())
        self.n_held += int(long.sum())
        self.pool, self.held = grown(self.pool, self.used), grown(self.held, self.n_held)
        self.pool[at[0] : self.used] = [i for x in ids for i in x]
        self.held[spot[0] : self.n_held] = np.frombuffer(b"".join(raw), np.uint8)
        self.fresh = merged(self.fresh, (keys, *(x.astype(np.int32) for x in (at, size, spot, long))))
        if len(self.fresh[0]) > len(self.large[0]) // 8:
            self.large, self.fresh = merged(self.large, self.fresh), tuple(x[:0] for x in self.fresh)
        return at, size

    def whole(self, text: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by the library alone."""
        ids = [self.library.encode(text[a:b].decode(), add_special_tokens=False).ids for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(off) - 1, np.int64)
        text = data.tobytes()
        if any(t.encode() in text for t in self.added):
            return self.whole(text, off)
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(lead)])[off]
        starts = self.bounds(points, chars)
        ends = np.append(starts[1:], len(points))
        byte = np.append(np.flatnonzero(lead), len(data))
        low, high = byte[starts], byte[ends]
        keys, first, inverse = np.unique(tv.word_hashes(data, low, high), return_index=True, return_inverse=True)
        long = high - low
        if (long != long[first][inverse]).any() or (data != data[np.arange(len(data)) + np.repeat(low[first][inverse] - low, long)]).any():
            return self.whole(text, off)
        if len(self.large[0]) + len(self.fresh[0]) > self.MOST or self.n_held > self.MOST_BYTES:
            self.empty()
        at, size, spot, known = self.find(keys)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        low, high, long = low[first], high[first], long[first]
        if (long[old] != known[old]).any():
            return self.whole(text, off)
        before = np.repeat(np.cumsum(long[old]) - long[old], long[old])
        step = np.arange(len(before)) - before
        if (data[np.repeat(low[old], long[old]) + step] != self.held[np.repeat(spot[old], long[old]) + step]).any():
            return self.whole(text, off)
        if len(new):
            at[new], size[new] = self.learn(keys[new], text, low[new], high[new])
        at, size = at[inverse], size[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return out, np.diff(total[np.searchsorted(starts, chars)])


def grown(pool: np.ndarray, n: int) -> np.ndarray:
    """A copy of the pool with room for n entries, or the pool itself."""
    return pool if n <= len(pool) else np.concatenate([pool, np.empty(max(n, 2 * len(pool)) - len(pool), pool.dtype)])


def merged(a: tuple, b: tuple) -> tuple:
    """Two tables of columns in order of their first, as one."""
    spot = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, spot, y) for x, y in zip(a, b, strict=True))


_made: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's encoder. Named, so that tasks find it by import; a nested function would bring an empty copy of the table."""
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


def encoder(path: str | None, end_id: int, carry: list[str], text: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces(path or default_tokenizer())
        before = 0
        for batch in batches:
            for part, data, off in tv.chunks(batch, text, tv.CHUNK // 2):
                ids, n = made.encode(data, off)
                stop = np.concatenate([[0], np.cumsum(n + 1)])
                out = np.full(stop[-1], end_id, np.int32)
                kept = np.ones(len(out), bool)
                kept[stop[1:] - 1] = False
                out[kept] = ids
                yield pa.record_batch(
                    [*(part.column(part.schema.get_field_index(c)) for c in carry), pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(out)), pa.array(before + stop[:-1], pa.int64())],
                    names=[*carry, "ids", "shard_offset"],
                )
                before += int(stop[-1])

    return tv.lean(rows)


def shards_for(size: int) -> int:
    """Shards of 16 MB of text, and of up to 512 MB where there would be more than 4,096."""
    return max(1, -(-size // min(max(16 << 20, size // 4096), 512 << 20)))


def write_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, shards: int | None = None, stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Encode docs and write <path>/data (columns doc_id, ids, shard, shard_offset) as ORC, one file a shard."""
    spark = docs.sparkSession
    base = own(docs, doc_id, text).toDF("doc_id", "text")
    n = shards or shards_for(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    dealt = base.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    coded = dealt.mapInArrow(encoder(tokenizer, end_id, ["doc_id"], "text"), f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, ids array<int>, shard_offset long")
    (coded.withColumn("shard", F.spark_partition_id()).write.format("orc").option("compression", "zstd").option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(index_stride))
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").save(f"{path}/data"))
    spark.read.schema("shard int, ids array<int>").orc(f"{path}/data").groupBy("shard").agg(F.sum(F.size("ids")).alias("n_ids"), F.count(F.lit(1)).alias("n_docs")).coalesce(1).write.orc(f"{path}/manifest")


@tv.lean
def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        off = ids.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "ids"]
        yield pa.record_batch([*rest, pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=[*(x for x in batch.schema.names if x != "ids"), "n_tokens", "ids_crc32"])


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, start): ids in all shards before; the manifest has one row a shard."""
    totals = spark.read.orc(f"{path}/manifest")
    return totals.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("start"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    data = spark.read.orc(f"{path}/data")
    kind = data.schema["doc_id"].dataType.simpleString()
    rows = data.select("doc_id", "shard", "shard_offset", "ids").mapInArrow(checksum, f"doc_id {kind}, shard int, shard_offset long, n_tokens long, ids_crc32 long")
    return rows.join(small(starts(spark, path)), "shard").select("doc_id", (F.col("start") + F.col("shard_offset")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The token ids of some documents; files, stripes and row groups that cannot hold them are skipped."""
    return spark.read.orc(f"{path}/data").where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def token_output(docs: DataFrame, **options) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_index(docs.sparkSession, path)


def op9_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
