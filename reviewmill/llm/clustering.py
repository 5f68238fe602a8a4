"""Clusters around centroids; each vector finds its nearest one by the threshold algorithm.

For every dimension the centroids are sorted by their value in it. A vector walks each of these lists
outward from its own value, nearest first, and meets centroids on its way; a centroid's exact distance
is computed when it is first met. A centroid not met yet differs in every dimension by at least the
difference at the frontier there, so the walk stops when the sum of the frontier's squared differences
exceeds the best distance (strictly, so that equal distances are met too; they go to the smaller number).

A round is one scan: tasks send the sums of their vectors by cluster, dimension and 40-bit digit, and
at most clusters x dimensions x digits sums reach the driver. Nothing else is shuffled or stored, so
the input is read once per round; store it first if it is costly to compute.

Components x count as floor(256 x). Defined cases: vectors that are null, are of another length than
``width``, or hold nulls or numbers that aren't finite take no part; there is no bound on finite ones
(Python integers take over where 64 bits might not do), but a distance or sum beyond 64 bits is given as
2**63 - 1; a row without an id takes part, and starts a cluster only if rows with ids are too few;
repeated rows and ids are rows of their own; fewer vectors than clusters give as many clusters as
vectors; an empty table gives an empty result; other columns are not read. There are no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm.vectors import EXACT, LONG, integers, largest, matrix, sound, whole
from reviewmill.scale import cut_lineage

SCALE = 256
WIDTH = 64
CLUSTERS = 40
ROUNDS = 5
BLOCK = 2048
DIGIT = 40


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number if several are."""
    n, width = rows.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, axis=0)
    dims = np.arange(width)[None, :]
    best, at = np.zeros(n, rows.dtype), np.full(n, -1)
    seen = np.zeros((n, k), bool)
    right = np.stack([np.searchsorted(values[:, d], rows[:, d]) for d in range(width)], axis=1)
    left = right - 1
    live = np.arange(n)
    for _ in range(k):
        x, low, high = rows[live], left[live], right[live]
        below = x - values[np.maximum(low, 0), dims]
        above = values[np.minimum(high, k - 1), dims] - x
        down = (low >= 0) & ((high >= k) | (below <= above))
        step = np.where(down, below, above)
        met = order[np.where(down, low, high), dims]
        left[live], right[live] = low - down, high + ~down
        fresh = np.zeros((len(live), k), bool)
        fresh[np.arange(len(live))[:, None], met] = True
        fresh &= ~seen[live]
        seen[live] |= fresh
        for c in np.flatnonzero(fresh.any(axis=0)):
            who = np.flatnonzero(fresh[:, c])
            apart = x[who] - centroids[c]
            far = (apart * apart).sum(axis=1)
            who = live[who]
            better = (at[who] < 0) | (far < best[who]) | ((far == best[who]) & (c < at[who]))
            best[who[better]], at[who[better]] = far[better], c
        frontier = (step * step).sum(axis=1)
        live = live[frontier <= best[live]]
        if not len(live):
            break
    return at, best


def _exact(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if no squared distance can exceed them, else as Python integers."""
    most = max([largest(rows), *(abs(x) for c in centroids for x in c)])
    if 4 * most * most * max(1, rows.shape[1]) < EXACT:
        return rows.astype(np.int64), np.array(centroids, np.int64)
    return integers(rows), np.array(centroids, object)


def _digits(number: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a number in base 2**40; the last digit has the sign."""
    place = 0
    while not -(1 << DIGIT) < number < 1 << DIGIT:
        yield place, number & ((1 << DIGIT) - 1)
        number >>= DIGIT
        place += 1
    yield place, number


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for start in range(0, len(batch), BLOCK):
        rows, centres = _exact(matrix(batch.column("v").slice(start, BLOCK), width), centroids)
        yield start, rows, *nearest(rows, centres)


def _moved(points: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after a round; those without vectors stay."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value)
        counts, totals = [0] * k, [[0] * width for _ in range(k)]
        for batch in batches:
            for _, rows, at, _ in _assigned(batch, shared.value, width):
                for c in np.unique(at):
                    counts[c] += int((at == c).sum())
                    totals[c] = [a + int(b) for a, b in zip(totals[c], rows[at == c].sum(axis=0), strict=True)]
        out = [
            (c, d, place, digit)
            for c in range(k)
            if counts[c]
            for d, number in enumerate([*totals[c], counts[c]])
            for place, digit in _digits(number)
        ]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["c", "d", "place", "digit"])

    partial = points.select("v").mapInArrow(sums, "c int, d int, place int, digit bigint")
    totals = [[0] * (width + 1) for _ in centroids]
    for r in partial.groupBy("c", "d", "place").agg(F.sum("digit").alias("digit")).collect():
        totals[r["c"]][r["d"]] += r["digit"] << (DIGIT * r["place"])
    return [[x // t[-1] for x in t[:-1]] if t[-1] else c for c, t in zip(centroids, totals, strict=True)]


def seeds(points: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [[int(x) for x in r["v"]] for r in points.orderBy(key.asc_nulls_last(), "v").limit(k).collect()]


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    salt: str = "2:",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector after ``rounds`` rounds, stored, and the centroids."""
    valid = vectors.where(sound(vec_col) & (F.size(vec_col) == width))
    points = valid.select(F.col(id_col).cast("bigint").alias("vec_id"), whole(vec_col, scale).alias("v"))
    centroids = seeds(points, k, salt)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = _moved(points, centroids, width)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, at, far in _assigned(batch, shared.value, width):
                cut = np.minimum(far, LONG).astype(np.int64)
                ids = batch.column("vec_id").slice(start, len(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(cut)], ["vec_id", "cluster", "distance"])

    return cut_lineage(points.mapInArrow(assign, schema)), centroids


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assigned rows with their cluster's and the whole inertia and the SHA-256 of its centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    total = min(sum(inertia.values()), LONG)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, min(s, LONG), total, digests[c]) for c, s in sorted(inertia.items())]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per cluster.
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
