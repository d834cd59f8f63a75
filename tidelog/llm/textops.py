"""Shared ways of streaming whole texts through numpy in bounded pieces."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: ASCII white space; all other bytes belong to words.
SPACES = bytes([32, *range(9, 14)])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes up to which a word is hashed in lockstep with others.
LONG = 256
_STEP = np.uint64(0xD6E8FEB86659FD93)


#: Bytes of an Arrow batch, however long the texts are.
BATCH_BYTES = 4 << 20


def streamed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with batches of about BATCH_BYTES (a setting of the session), and with its memory given back to the system
    when a task ends, for idle Python workers stay beside the tasks that follow."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def column_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes together; a longer text is alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """Words of some texts: buf (all bytes), start and end of each word in it, doc (its text's index), first (each text's first word)."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join([*texts, b""])
        self.buf = np.frombuffer(joined, np.uint8)
        space = _IS_SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.first = np.concatenate(([0], np.searchsorted(self.start, self.ends, "left")))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, taken in chunks of eight bytes."""
        n = self.end - self.start
        h = mix64(n.astype(np.uint64) * _STEP)
        if not len(n):
            return h
        padded = np.concatenate((self.buf, np.zeros(8, np.uint8)))
        chunks = np.ndarray((len(self.buf) + 1,), "<u8", padded, 0, (1,))
        of, at, left = slice(None), self.start, n
        for _ in range(LONG // 8):
            value = chunks[at] & _MASK[np.minimum(left, 8)]
            h[of] = mix64((h[of] ^ value) * _P)
            more = np.flatnonzero(left > 8)
            if not len(more):
                return h
            of = more if isinstance(of, slice) else of[more]
            at, left = at[more] + 8, left[more] - 8
        for i in of:  # words longer than LONG bytes
            raw = self.buf[self.start[i] : self.end[i]].tobytes()
            h[i] = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)[0]
        return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values; len(h) - k + 1 of them (none if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _STEP
        out += h[j : j + n]
    return mix64(out ^ np.uint64(k))
