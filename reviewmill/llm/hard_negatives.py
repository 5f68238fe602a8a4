"""Hard negatives by an inverted multi-index: rows of another label that score nearly as high as a positive.

Vectors are cut into two halves, each with a codebook of its own; a pair of codewords is a cell. A
row of a cell scores with an anchor at most the sum of two bounds, one per half: the codeword's product
plus the half's norm times the codeword's radius. With both codebooks sorted by these bounds, a heap
over their sorted pairs (the multi-sequence algorithm) visits cells by falling sums, so all rows not
visited yet score at most the next sum. That certifies a window: an anchor's positives are complete
once the last of them scores above the next sum, the negatives of a positive once that many are found
above it or it has left the window.

Every anchor does this twice, for its positives and then for the negatives of their windows, each time
in two steps: the first cells, which hold ``NEAR`` rows, give a floor, and the second step goes on to
where the floor certifies the rest, leaving out cells whose lower bound lies above all windows.

The codebooks are fitted on at most ``SAMPLE`` rows, the first by a hash; every row is in the index, and
the result is exact whatever the codebooks. Rows meet anchors in units of at most ``CHUNK`` rows: small
cells share a unit, a large cell (of equal vectors, say) is several, and a crowd of anchors is cut as
well. What is ranked is cut to the number asked for before it is shuffled.

Components x count as floor(256 x). Defined cases: rows without an id, a label or a vector, or with null
or non-finite components take no part; shorter vectors count as ending in zeros; finite components may
be of any size, but products beyond 64 bits count as the nearest 64-bit number; equal scores go by
smaller id; rows that repeat an id are rows of their own, each the other's candidate; an anchor without
positives or a positive without negatives gives no row; an empty table gives an empty result; other
columns are not read, whatever their names. There are no texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.vectors import LONG, matrix, numbered, products, sound, whole
from reviewmill.scale import attach_small, cut_lineage

SCALE = 256
SAMPLE = 16_384
STEPS = 6
# Codewords per half, at most.
CODEWORDS = 64
CHUNK = 4096
NEAR = 4096
BLOCK = 512


def _nearest(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword and its distance; any codeword would keep the result right."""
    far = (rows * rows).sum(1)[:, None] - 2 * rows @ words.T + (words * words).sum(1)[None, :]
    at = far.argmin(1)
    return at, np.sqrt(((rows - words[at]) ** 2).sum(1))


def codebook(rows: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` codewords fitted by a few rounds of Lloyd's algorithm."""
    words = np.unique(rows, axis=0) if rows.shape[1] else np.zeros((1, 0))
    words = words[np.linspace(0, len(words) - 1, min(k, len(words))).astype(int)].astype(float)
    for _ in range(STEPS):
        at, _ = _nearest(rows, words)
        for c in np.unique(at):
            words[c] = rows[at == c].mean(axis=0)
    return words


def falling(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of the two lists by falling sum."""
    one, two = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    a, b = first[one].tolist(), second[two].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, one[i], two[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Index:
    """Codebooks, radii and the units of each cell; its size doesn't grow with the rows."""

    def __init__(self, words: list[np.ndarray], radii: list[np.ndarray], counts: np.ndarray):
        self.words, self.radii, self.counts = words, radii, counts
        self.first, self.units = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
        unit, room = -1, 0
        for cell, n in np.ndenumerate(counts):
            if n > room:
                self.units[cell] = -(-n // CHUNK)
                self.first[cell] = unit + 1
                unit += int(self.units[cell])
                room = CHUNK - n if n <= CHUNK else 0
            elif n:
                self.units[cell], self.first[cell] = 1, unit
                room -= n

    def bounds(self, half: int, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest products with the rows of each codeword, a little wider than rounding."""
        with np.errstate(all="ignore"):
            centre = self.words[half] @ vector
            reach = np.sqrt((vector * vector).sum()) * self.radii[half]
            slack = 1e-9 * (np.abs(centre) + reach) + 1
            high, low = centre + reach + slack, centre - reach - slack
        return np.where(np.isnan(high), np.inf, high), np.where(np.isnan(low), -np.inf, low)

    def route(self, vector: np.ndarray, near: bool, floor: float, ceiling: float) -> list[int]:
        """Units of the first cells; or of those after them that may hold scores from floor to ceiling."""
        cut = self.words[0].shape[1]
        (high0, low0), (high1, low1) = self.bounds(0, vector[:cut]), self.bounds(1, vector[cut:])
        before: set[int] = set()
        after: set[int] = set()
        held = 0
        for total, i, j in falling(high0, high1):
            # Scores cut to 64 bits all tie at the lowest.
            if held >= NEAR and (near or total < floor > -LONG):
                break
            n = int(self.counts[i, j])
            if not n:
                continue
            units = range(self.first[i, j], self.first[i, j] + self.units[i, j])
            if held < NEAR:
                before.update(units)
            elif low0[i] + low1[j] <= ceiling:
                after.update(units)
            held += n
        return sorted(before) if near else sorted(after - before)


def build_index(points: DataFrame, width: int) -> tuple[Index, DataFrame]:
    """The index and the points with their unit; ``points`` has row and v."""
    size = points.count()
    cut = (width + 1) // 2
    k = max(2, min(CODEWORDS, int(size**0.25)))
    sample = matrix(points.orderBy(F.xxhash64("v"), "row").limit(SAMPLE).select("v").toArrow().column("v"), width)
    with np.errstate(all="ignore"):
        words = [codebook(sample[:, :cut], k), codebook(sample[:, cut:], k)]
    shared = points.sparkSession.sparkContext.broadcast(words)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), width)
            with np.errstate(all="ignore"):
                (at0, far0), (at1, far1) = _nearest(rows[:, :cut], shared.value[0]), _nearest(rows[:, cut:], shared.value[1])
            more = [pa.array(at0, pa.int32()), pa.array(at1, pa.int32()), pa.array(far0), pa.array(far1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "c0", "c1", "far0", "far1"])

    schema = "row bigint, id bigint, label bigint, v array<double>, c0 int, c1 int, far0 double, far1 double"
    dealt = cut_lineage(points.mapInArrow(assign, schema))
    # At most CODEWORDS squared rows.
    cells = dealt.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).collect()
    counts = np.zeros((len(words[0]), len(words[1])), np.int64)
    radii = [np.zeros(len(w)) for w in words]
    for r in cells:
        counts[r["c0"], r["c1"]] = r["n"]
        for half, c, far in ((0, r["c0"], r["far0"]), (1, r["c1"], r["far1"])):
            # A distance too large to compute bounds nothing.
            radii[half][c] = np.inf if np.isnan(far) else max(radii[half][c], far)
    index = Index(words, radii, counts)
    table = [(*map(int, cell), int(index.first[cell]), int(index.units[cell])) for cell, n in np.ndenumerate(counts) if n]
    places = F.broadcast(points.sparkSession.createDataFrame(table, "c0 int, c1 int, first bigint, units bigint"))
    unit = F.col("first") + F.pmod(F.xxhash64("row"), "units")
    return index, dealt.join(places, ["c0", "c1"]).select("row", "id", "label", "v", unit.alias("unit"))


def _visit(
    anchors: DataFrame, rows: DataFrame, index: Index, width: int, near: bool, solve: Callable[..., list[np.ndarray]], names: list[str]
) -> DataFrame:
    """What ``solve`` finds in the units that each anchor visits in this step.

    ``anchors`` has row, id, label, v, floor and ceiling, and ``tops``, the scores of its positives.
    """
    shared = anchors.sparkSession.sparkContext.broadcast((index.words, index.radii, index.counts))

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            vectors = matrix(batch.column("v"), width)
            floor, ceiling = batch.column("floor").to_numpy(), batch.column("ceiling").to_numpy()
            units = [index.route(*x) for x in zip(vectors, [near] * len(batch), floor, ceiling, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.list_(pa.int64()))], [*batch.schema.names, "units"])

    fields = "row bigint, id bigint, label bigint, v array<double>, floor double, ceiling double, tops array<bigint>"
    asked = anchors.mapInArrow(routes, f"{fields}, units array<bigint>").withColumn("unit", F.explode("units")).drop("units")
    asked = cut_lineage(asked)
    crowds = asked.groupBy("unit").agg(F.ceil(F.count("*") / CHUNK).alias("crowds"))
    left = attach_small(asked, crowds, ["unit"]).withColumn("crowd", F.pmod(F.xxhash64("row"), "crowds"))
    right = attach_small(rows, crowds, ["unit"]).withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("crowds") - 1)))

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        parts = [pa.table({n: pa.array([], pa.int64()) for n in names})]
        if len(held):
            ids, numbers, labels = (held.column(c).to_numpy() for c in ("id", "row", "label"))
            data = matrix(held.column("v"), width)
            for start in range(0, len(asking), BLOCK):
                part = asking.slice(start, BLOCK)
                scores = products(matrix(part.column("v"), width), data)
                own = part.column("row").to_numpy()
                found = solve(part, scores, own[:, None] == numbers[None, :], part.column("label").to_numpy()[:, None] == labels[None, :], ids)
                parts.append(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, found, strict=True)}))
        return pa.concat_tables(parts)

    keys = ("unit", "crowd")
    return left.drop("crowds").groupBy(*keys).cogroup(right.drop("crowds").groupBy(*keys)).applyInArrow(
        meet, ", ".join(f"{n} bigint" for n in names)
    )


def _best(scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores that fit, equal ones by id."""
    row, column = np.nonzero(fit)
    order = np.lexsort((ids[column], -scores[row, column].astype(float), row))
    # Floats order nearly: whole numbers break their ties.
    row, column = row[order], column[order]
    score = scores[row, column]
    if len(score) and np.abs(score).max() >= 1 << 53:
        order = np.array(sorted(range(len(row)), key=lambda x: (row[x], -int(score[x]), ids[column[x]])))
        row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k highest scores of each key; the rank is limited before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for rows that meet ``anchors``, a condition on ``id``.

    Positives are the anchor's highest scores among other rows of its label; negatives of a positive
    the highest scores of other labels from ``percent`` of its score up to it.
    """
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & sound(vec_col))
    points = valid.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole(vec_col, scale).alias("v"))
    points = cut_lineage(numbered(points).select("row", "id", "label", "v"))
    width = points.agg(F.max(F.size("v"))).first()[0] or 0
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        width = 1
    if points.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    index, rows = build_index(points, width)
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    asking = points.where(anchors).withColumns({"floor": least, "ceiling": most, "tops": F.array().cast("array<bigint>")})

    def alike(part, scores, own, same, ids):
        floor = part.column("floor").to_numpy()[:, None]
        i, j = _best(scores, same & ~own & (scores >= floor), ids, positives)
        return [part.column("row").to_numpy()[i], ids[j], scores[i, j]]

    names = ["anchor", "id", "score"]
    first = cut_lineage(_ranked(_visit(asking, rows, index, width, True, alike, names), ["anchor"], positives))
    floors = first.where(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").cast("double").alias("known"))
    again = asking.join(floors, "row", "left").withColumn("floor", F.coalesce("known", "floor")).drop("known")
    more = _visit(again.select(*asking.columns), rows, index, width, False, alike, names)
    found = cut_lineage(_ranked(first.drop("rank").unionByName(more), ["anchor"], positives))

    # At most ``positives`` scores per anchor. Below 0 no score lies in the window.
    tops = found.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("tops"))
    wanted = points.where(anchors).join(tops.withColumnRenamed("anchor", "row"), "row")
    wanted = wanted.select("row", "id", "label", "v", (F.get("tops", F.size("tops") - 1) * (percent / 100)).alias("floor"), F.get("tops", 0).cast("double").alias("ceiling"), "tops")
    wanted = cut_lineage(wanted.withColumn("floor", F.col("floor") * (1 - 1e-9) - 1))

    def unlike(part, scores, own, same, ids):
        numbers = part.column("row").to_numpy()
        out = [[] for _ in range(4)]
        lists = part.column("tops").to_pylist()
        for place in range(max(map(len, lists))):
            top = np.array([t[place] if place < len(t) else -1 for t in lists], np.int64)[:, None]
            low = -(-top.astype(object) * percent // 100) if top.max() > LONG // 100 else -(-top * percent // 100)
            floor = part.column("floor").to_numpy()[:, None]
            fit = ~same & (scores <= top) & (scores >= low) & (scores >= floor) & (top >= 0)
            i, j = _best(scores, fit, ids, negatives)
            for column, values in zip(out, (numbers[i], np.full(len(i), place), ids[j], scores[i, j]), strict=True):
                column.append(values)
        return [np.concatenate(c) for c in out]

    names = ["anchor", "place", "id", "score"]
    first = cut_lineage(_ranked(_visit(wanted, rows, index, width, True, unlike, names), ["anchor", "place"], negatives))
    # An anchor's floor is the lowest of its windows' last scores; a window that isn't full keeps its own end.
    full = first.where(F.col("rank") == negatives).groupBy("anchor").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    again = wanted.join(full.withColumnRenamed("anchor", "row"), "row", "left")
    certified = F.when(F.col("n") == F.size("tops"), F.greatest("floor", F.col("last").cast("double"))).otherwise(F.col("floor"))
    again = again.withColumn("floor", certified).select(*wanted.columns)
    more = _visit(again, rows, index, width, False, unlike, names)
    best = _ranked(first.drop("rank").unionByName(more), ["anchor", "place"], negatives)
    named = found.where("score >= 0").select(
        "anchor", (F.col("rank") - 1).cast("bigint").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    ids = points.where(anchors).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    joined = best.join(named, ["anchor", "place"]).join(ids, "anchor")
    return joined.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
