"""Hashed word and word-pair features of texts, and counts of them over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.words import WordHashes, blocks, mix, ngram_hashes, returning

#: Features share 2**16 buckets, which bounds a model whatever the corpus.
BUCKETS = 1 << 16
#: Bytes of text whose features are held at once; each takes some dozens of bytes.
BLOCK = 1 << 19
# Buckets whose counts go to Spark at once.
SENT = 1 << 12


def features(values: list[bytes | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbouring words of the texts."""
    lists = [(v or b"").lower().split() for v in values]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = hashes.of([w for words in lists for w in words])
    row = np.repeat(np.arange(len(lists)), lengths)
    pairs = ngram_hashes(flat, 2)
    inside = row[1:] == row[:-1]
    words = mix(flat) % np.uint64(BUCKETS)
    pairs = pairs[inside] % np.uint64(BUCKETS)
    return np.concatenate([row, row[1:][inside]]), np.concatenate([words, pairs]).astype(np.int64)


def class_counts(docs: DataFrame, n_classes: int, label: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(bucket, counts): how often each bucket occurs in the documents of each class.

    ``label`` gives the classes of a batch's rows; rows of class -1 count in none but are part of the
    last count, that of all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        counts = np.zeros((n_classes + 1, BUCKETS), np.int64)
        for batch in batches:
            cls = label(batch)
            for start, end, values in blocks(batch, limit=BLOCK):
                row, bucket = features(values, hashes)
                counts[n_classes] += np.bincount(bucket, minlength=BUCKETS)
                of = cls[start:end][row]
                for c in range(n_classes):
                    if (of == c).any():
                        counts[c] += np.bincount(bucket[of == c], minlength=BUCKETS)
        used = np.flatnonzero(counts[n_classes])
        names = ["bucket"] + [f"c{c}" for c in range(n_classes + 1)]
        for first in range(0, len(used), SENT):
            some = used[first : first + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(row[some]) for row in counts], names)

    columns = ", ".join(f"c{c} bigint" for c in range(n_classes + 1))
    partial = docs.mapInArrow(returning(run), f"bucket bigint, {columns}")
    return partial.groupBy("bucket").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(n_classes + 1)))


def collect_counts(counted: DataFrame, n_classes: int) -> np.ndarray:
    """The counts as an array of n_classes + 1 rows; at most ``BUCKETS`` rows come to the driver."""
    out = np.zeros((n_classes + 1, BUCKETS))
    rows = counted.toPandas()
    for c in range(n_classes + 1):
        out[c, rows["bucket"].to_numpy(np.int64)] = rows[f"c{c}"].to_numpy(float)
    return out
