"""Words and their hashes, shared by the operators that run numpy inside tasks.

Words are the runs of bytes between blanks and the control characters 9 to 13, with A-Z in lower
case; that is how ``bytes.lower().split()`` cuts UTF-8, without decoding it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
CACHED_WORDS = 150_000


class WordHashes(dict):
    """Remembers the 64-bit hash of each word met, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list]]:
    """(first row, row after the last, UTF-8 values) of stretches of about ``limit`` bytes."""
    values = batch.column(column).cast(pa.binary())
    ends = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy())
    start = 0
    while start < len(values):
        done = ends[start - 1] if start else 0
        end = min(len(values), int(np.searchsorted(ends, done + limit)) + 1)
        yield start, end, values.slice(start, end - start).to_pylist()
        start = end


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for later tasks, with what it once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def returning(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, that gives back at the task's end what it took."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; n - 1 shorter than the input."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        total = (total + hashes[i : len(hashes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
        total ^= total >> np.uint64(29)
    return mix(total)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
