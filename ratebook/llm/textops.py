"""Words of whole texts as numpy arrays: kernels that the operators share inside Arrow tasks.

All of them work on the UTF-8 bytes of a block of rows.  A block holds about ``BLOCK`` bytes of text (one longer text
is a block of its own), so memory does not depend on how many rows an Arrow batch has.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK = 1 << 19
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
U = np.uint64


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Separators of words: white space of ASCII.
SPACE = _table(b" \t\n\x0b\x0c\r")
#: Separators of alphanumeric words: all of ASCII but digits and letters.
NOT_ALNUM = _table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Hashes are polynomials modulo the prime 2**61 - 1: unlike those modulo 2**64, whose lower bits repeat, they part any two
#: different texts for all but a few of the bases.  These two were drawn at random.
PRIME = (1 << 61) - 1
_BASE, _WORD_BASE = 0x0F3D9A6C5B87E421, 0x1A94C7E20D6B35F7
_P = U(PRIME)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Limit the Arrow batches that Python tasks get, by rows and bytes, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    # workers on this machine import the package from where it is; on a cluster it is installed or on PYTHONPATH
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), ROOT])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of values below it."""
    a1, a0, b1, b0 = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    middle = a1 * b0 + a0 * b1
    total = (a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & U(0x3FFFFFFF)) << U(31))
    return _reduced(_reduced(total) + _reduced(a0 * b0))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo PRIME."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U)
        while len(have) < max(n, BLOCK + 1):
            have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), PRIME), U))])
        _POWERS[base] = have
    return have[:n]


@lru_cache(None)
def inverse(base: int) -> int:
    return pow(base, -1, PRIME)


class _Sums:
    """Sums of any run of value[i] * power[i] modulo PRIME, from two halves of each term that are added up as they are."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        """Term i is low[i] + high[i] * 2**32; a block has fewer than 2**22 terms, each half less than 2**41."""
        self.low, self.high = np.zeros(len(low) + 1, U), np.zeros(len(low) + 1, U)
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = self.low[end] - self.low[start], self.high[end] - self.high[start]
        high = _reduced(high)  # high * 2**32 is (high >> 29) * 2**61 and the rest
        return _reduced(_reduced(low) + (high >> U(29)) + ((high & U(0x1FFFFFFF)) << U(32)))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds): row i of the block has bytes[bounds[i]:bounds[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


class Words:
    """Words of a block: word i is bytes[start[i]:end[i]]; document d has words first[d] .. first[d + 1] - 1."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
        self.data, self.bounds = data, bounds
        word = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | cut[1:-1]
        ends[:-1] &= ~word[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def stop(self) -> np.ndarray:
        """For each word the number of the word that follows its document."""
        return np.repeat(self.first[1:], self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], whatever their lengths, in a few passes over the bytes."""
    value, power = data.astype(U) + U(1), powers(_BASE, len(data))
    sums = _Sums(value * (power & U(0xFFFFFFFF)), value * (power >> U(32)))
    found = times(sums.of(start, end), powers(inverse(_BASE), len(data) + 1)[start])
    return mix(found + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, stored: np.ndarray, first: np.ndarray, size: np.ndarray) -> bool:
    """Whether each data[start:end] is stored[first:first + size]; the spans follow each other from 0 to the end."""
    if (end - start != size).any():
        return False
    at = np.repeat((first - start).astype(np.int32), size) + np.arange(len(data), dtype=np.int32)
    return bool((stored[at] == data).all())


class Sequences:
    """Hashes of any run of consecutive words, from prefix sums over the hashes of words."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        base = (_WORD_BASE + salt) % PRIME
        term = times(_reduced(mix(hashes ^ U(salt)) if salt else hashes), powers(base, len(hashes)))
        self.size = len(hashes)
        self.sums = _Sums(term & U(0xFFFFFFFF), term >> U(32))
        self.back = powers(inverse(base), len(hashes) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        length = np.asarray(length)
        found = times(self.sums.of(start, start + length), self.back[start])
        return mix(found + length.astype(U) * U(0x9FB21C651E98DF25))

    def all(self, length: int) -> np.ndarray:
        """Of each run of ``length`` words, those over the ends of documents included."""
        n = self.size - length + 1
        return self.of(np.arange(n), length) if n > 0 else np.empty(0, U)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster here than numpy's hash table."""
    if not len(x):
        return x
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned or signed 64-bit values as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), longs(values) if kind is None else pa.array(values, kind))
