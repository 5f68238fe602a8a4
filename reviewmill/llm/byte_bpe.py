"""Byte-level BPE: texts to ids and ids to bytes, by ranks read from a file.

A text is cut into pre-tokens by a pattern, and each is looked up in two tiers. The first is a minimal
perfect hash of the vocabulary: one slot per token and no empty ones, so a pre-token's hash leads to
the only token it can be, and comparing the two decides. The second is for the rest: its bytes are a
linked list, the ranks of neighbours wait in a heap, and the lowest rank merges first, the leftmost of
equal ones, until no two neighbours form a token.

The vocabulary goes to every executor; its size is the file's, not the data's. Texts are cut into blocks
of bounded bytes; distinct pre-tokens of a block are looked up at once. A pre-token of n bytes costs
n log n. The ids of short ones are remembered by the worker, about ``REMEMBERED`` of them.

Defined cases: a null or empty text has no ids and decodes to no bytes; a very long text is encoded
whole; bytes that aren't UTF-8 count as U+FFFD; ids are unique per text, so there are no ties; null
and repeated document ids keep their rows; an empty table gives an empty result; other columns are not
read, whatever their names. Decoding stops at an id that the vocabulary lacks.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.words import blocks, mix

# Pre-tokens whose ids a worker remembers, some 200 bytes each, and the characters they may have.
REMEMBERED = 600_000
LONGEST = 64
# Tokens per bucket of the perfect hash.
LOAD = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Token and rank of each line of a rank file, on the driver."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash of tokens, by hashing, bucketing and displacing.

    Tokens that share a bucket share a displacement, found by trial, that sends them to free slots;
    buckets are placed largest first, and those of one token are given a free slot outright.
    """

    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        n = self.n = len(tokens)
        self.buckets = max(1, n // LOAD)
        for self.seed in range(64):
            hashes = self.hashes(tokens)
            if len(np.unique(hashes)) == n:
                break
        else:
            raise ValueError("tokens repeat")
        bucket = hashes % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        sizes = np.diff(bounds)
        self.moves = np.zeros(self.buckets, np.int64)
        owner = np.full(n, -1)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) < 2:
                break
            self.moves[b], slots = self._free(hashes[members], owner)
            owner[slots] = members
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(owner < 0)
        self.moves[single] = -free - 1
        owner[free] = order[bounds[single]]
        self.tokens = [tokens[i] for i in owner]
        self.ranks = np.array([ranks[t] for t in self.tokens], np.int64)

    @classmethod
    def of(cls, state: dict) -> PerfectHash:
        """The table whose ``vars`` these are; they are plain values, which any executor can read."""
        table = cls.__new__(cls)
        table.__dict__.update(state)
        return table

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(t, self.seed) for t in tokens), np.uint64, len(tokens))

    def _free(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[int, np.ndarray]:
        for start in range(0, 1 << 40, 256):
            tries = np.arange(start, start + 256)
            slots = self._slots(hashes[None, :], tries[:, None])
            ordered = np.sort(slots, axis=1)
            good = (owner[slots] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                at = int(good.argmax())
                return start + at, slots[at]
        raise ValueError("no displacement found")

    def _slots(self, hashes: np.ndarray, moves: np.ndarray) -> np.ndarray:
        salted = mix(hashes + moves.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (salted % np.uint64(self.n)).astype(np.int64)

    def find(self, pieces: list[bytes]) -> list[int]:
        """Rank of each piece, -1 for those that are no token."""
        if not pieces or not self.n:
            return [-1] * len(pieces)
        hashes = self.hashes(pieces)
        moves = self.moves[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(moves < 0, -moves - 1, self._slots(hashes, np.maximum(moves, 0)))
        ranks = self.ranks[slots].tolist()
        return [r if self.tokens[s] == p else -1 for p, s, r in zip(pieces, slots.tolist(), ranks, strict=True)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: its bytes, of which neighbours merge by rank."""
    n = len(piece)
    get = ranks.get
    following = list(range(1, n + 1))
    before = list(range(-1, n))
    # A pair waits as one number, its rank and then its place; ``waiting`` has the valid one of each place.
    waiting = [-1 if (r := get(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    waiting.append(-1)
    heap = [w for w in waiting if w >= 0]
    heapq.heapify(heap)
    while heap:
        pair = heapq.heappop(heap)
        i = pair % n
        if waiting[i] != pair:
            continue
        mid = following[i]
        end = following[i] = following[mid]
        waiting[i] = waiting[mid] = -1
        if end < n:
            before[end] = i
            if (r := get(piece[i : following[end]])) is not None:
                waiting[i] = r * n + i
                heapq.heappush(heap, waiting[i])
        if i:
            start = before[i]
            if (r := get(piece[start:end])) is None:
                waiting[start] = -1
            else:
                waiting[start] = r * n + start
                heapq.heappush(heap, waiting[start])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class Encoder:
    """Encodes blocks of texts in a task.

    ``known`` has the ids of pre-tokens met before, as bytes of 32-bit numbers. It may be a dictionary that
    outlives the task.
    """

    def __init__(self, table: PerfectHash, pattern: str, known: dict[str, bytes] | None = None):
        self.table = table
        self.cut = regex.compile(pattern).findall
        self.ranks = dict(zip(table.tokens, table.ranks.tolist(), strict=True))
        self.known = {} if known is None else known

    def _learn(self, distinct: set[str]) -> list[str]:
        """Look up the pre-tokens not known yet; those too long to be remembered are returned."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in distinct if p not in self.known]
        pieces = [p.encode() for p in new]
        for p, piece, rank in zip(new, pieces, self.table.find(pieces), strict=True):
            ids = [rank] if rank >= 0 else merged(piece, self.ranks)
            self.known[p] = struct.pack(f"<{len(ids)}i", *ids)
        return [p for p in new if len(p) > LONGEST]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        cut = [self.cut(t) for t in texts]
        long = self._learn(set().union(*cut))
        packed = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        for p in long:
            del self.known[p]
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        return np.frombuffer(b"".join(packed), "<i4"), counts


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    # A worker reads the table once for all its tasks, so they share what one of them remembers.
    table = docs.sparkSession.sparkContext.broadcast((vars(PerfectHash(ranks)), {}))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known = table.value
        encoder = Encoder(PerfectHash.of(state), pattern, known)
        for batch in batches:
            for start, end, values in blocks(batch):
                ids, counts = encoder.encode([(v or b"").decode(errors="replace") for v in values])
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), lists], ["doc_id", "ids"])

    return source.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows of (doc_id, ids) with ``decoded``, the bytes that the ids stand for."""
    size = max(ranks.values(), default=-1) + 1
    tokens: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            texts = [b"".join(map(known.__getitem__, flat[a:b].tolist())) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
