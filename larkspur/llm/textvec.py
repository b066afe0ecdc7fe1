"""Vectorised words and rolling hashes over Arrow text columns, for operators that run in Arrow batches.

A chunk is some whole rows whose texts have about CHUNK bytes together; a longer text is a chunk of its own.
Hashes are polynomials over bytes (or over word hashes) modulo 2**64 taken from prefix sums, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

CHUNK = 1 << 20
LONG = 32
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so both can be inverted


def lean(rows: Callable) -> Callable:
    """A function for mapInArrow that gives free memory back when its task ends.

    Workers live on after a task while the JVM beside them runs the next stage; arrays of chunks leave the allocators
    with pages that nobody uses.
    """

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            _bytes.forget()
            _words.forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
            if trim:
                trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """base**i and base**-i modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.forget()

    def forget(self) -> None:
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1024)
            self.up, self.down = (self._run(b, self.n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_bytes, _words = Powers(BASE), Powers(WORD_BASE)


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets of the rows in these) again and again; null texts count as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


PLAIN = table(b" \t\n\x0b\x0c\r")
ALNUM = table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more for the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = off[1:] > off[:-1]
    heads, tails = off[:-1][full], off[1:][full] - 1
    first[heads], last[tails] = w[heads], w[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word.

    Polynomials modulo 2**64 are equal for some pairs of long regular words whatever the base (a Thue-Morse word of a
    thousand letters and its complement), so words of more than LONG bytes are hashed one by one by XXH3.
    """
    up, down = _bytes.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):
        held = memoryview(np.ascontiguousarray(data))
        out[long] = [xxh3_64_intdigest(held[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


class Runs:
    """Hashes of runs of words, from the words' hashes."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _words.upto(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])
