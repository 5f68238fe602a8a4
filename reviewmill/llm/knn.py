"""Exact top-k search by inner product: a Voronoi join.

Every vector belongs to the cell of its nearest pivot. A cell's summary, its pivot, radius and size,
bounds each query's products within it: q·x = q·p + q·(x - p) <= q·p + |q| r. First a query is solved
in the cells its products with the pivots favour, just enough of them to hold k rows; the k-th score
found there is a floor, and the query is then sent only to the other cells whose bound reaches it.

Cells are cut into chunks of bounded size, and so are the queries sent to one, so a crowd of equal
vectors or of queries fills many tasks, none of them further than others.

Components x count as floor(64 x). Defined cases: vectors that are null, hold nulls or numbers that
aren't finite take no part, nor do rows without an id; finite components may be of any size (Python
integers take over where floating point isn't exact), but products beyond 64 bits count as the nearest
64-bit number; shorter vectors count as ending in zeros; rows that repeat an id are rows of their own,
each the other's candidate; ties go to the smaller id; empty tables give empty results; other columns
are not read, whatever their names. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.vectors import LONG, matrix, numbered, products, sound, whole
from reviewmill.scale import cut_lineage

SCALE = 64
# Pivots are a sample of this size at most; the search is exact whatever the sample.
PIVOTS = 1024
CHUNK = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, id, v): the vectors that take part, as whole numbers, numbered."""
    valid = vectors.where(F.col(id_col).isNotNull() & sound(vec_col))
    return numbered(valid.select(F.col(id_col).cast("bigint").alias("id"), whole(vec_col, SCALE).alias("v")))


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products with other rows of each query row.

    ``queries`` is a condition on ``id``.
    """
    spark = vectors.sparkSession
    points = cut_lineage(quantised(vectors, id_col, vec_col))
    size, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    if not size or not width:
        width = 1
    wanted = min(PIVOTS, max(1, int(size**0.5) // 2))
    sample = points.orderBy(F.xxhash64("id"), "row").limit(wanted).select("v").toArrow()
    pivots = np.unique(matrix(sample.column("v"), width), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            rows = matrix(batch.column("v"), width)
            with np.errstate(all="ignore"):
                far = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)[None, :]
                cell = far.argmin(1)
                away = np.sqrt(((rows - centres[cell]) ** 2).sum(1))
            # A distance too large to compute bounds nothing.
            away = np.where(np.isnan(away), np.inf, away)
            columns = [batch.column(c) for c in ("row", "id", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32()), pa.array(away)], ["row", "id", "v", "cell", "away"])

    dealt = cut_lineage(points.mapInArrow(nearest, "row bigint, id bigint, v array<double>, cell int, away double"))
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas()
    counts, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    counts[cells["cell"]], radius[cells["cell"]] = cells["n"], cells["radius"]
    summary = spark.sparkContext.broadcast((pivots, counts, radius))

    def routes(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, held, reach = summary.value
            for batch in batches:
                rows = matrix(batch.column("v"), width)
                with np.errstate(all="ignore"):
                    centre = rows @ centres.T
                    reached = np.sqrt((rows * rows).sum(1))[:, None] * reach
                    bound = centre + reached + 1e-9 * (np.abs(centre) + reached) + 0.5
                # What can't be computed bounds nothing; scores cut to 64 bits all tie at the lowest.
                bound = np.maximum(np.where(np.isnan(bound), np.inf, bound), -float(LONG))
                order = np.argsort(np.where(held > 0, -np.nan_to_num(centre), np.inf), axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                near = np.zeros(centre.shape, bool)
                np.put_along_axis(near, order, before <= k, axis=1)
                if first:
                    go = near & (held > 0)
                else:
                    floor = batch.column("floor").to_numpy(False)[:, None]
                    go = ~near & (held > 0) & (bound >= floor)
                at, cell = np.nonzero(go)
                columns = [batch.column(c).take(pa.array(at)) for c in ("row", "id", "v", "floor")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32())], ["row", "id", "v", "floor", "cell"])

        return run

    routed = "row bigint, id bigint, v array<double>, floor double, cell int"
    asking = dealt.where(queries).select("row", "id", "v")
    start = asking.withColumn("floor", F.lit(float("-inf"))).mapInArrow(routes(True), routed)
    found = cut_lineage(_solve(start, dealt, counts, width, k))
    floors = found.groupBy("row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    floors = floors.select("row", F.get("s", F.lit(k - 1)).cast("double").alias("floor"))
    again = asking.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = _solve(again.select("row", "id", "v", "floor").mapInArrow(routes(False), routed), dealt, counts, width, k)
    best = F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("vec_id")).alias("order"), F.col("vec_id"))), asc=False)
    return (
        found.union(more)
        .groupBy("row", "query_id")
        .agg(F.slice(best, 1, k).alias("best"))
        .select("query_id", F.posexplode("best").alias("at", "b"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
    )


def _solve(asked: DataFrame, dealt: DataFrame, counts: np.ndarray, width: int, k: int) -> DataFrame:
    """(row, query_id, vec_id, score) of the k best rows at or above its floor in each chunk a query is sent to."""
    spark = dealt.sparkSession
    table = [(c, int(-(-n // CHUNK))) for c, n in enumerate(counts.tolist()) if n]
    chunks = F.broadcast(spark.createDataFrame(table, "cell int, chunks int"))
    asked = cut_lineage(asked)
    crowds = asked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("crowds")).toPandas()
    crowd = F.broadcast(
        spark.createDataFrame([(int(c), int(n)) for c, n in zip(crowds["cell"], crowds["crowds"], strict=True)], "cell int, crowds int")
    )
    left = (
        asked.join(chunks, "cell")
        .join(crowd, "cell")
        .withColumn("crowd", F.pmod(F.xxhash64("row"), "crowds").cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cell", "chunk", "crowd", "row", "id", "v", "floor")
    )
    right = (
        dealt.join(chunks, "cell")
        .join(crowd, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int"))
        .withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
        .select("cell", "chunk", "crowd", "row", "id", "v")
    )

    def solve(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("row", "query_id", "vec_id", "score")})
        if not len(queries) or not len(rows):
            return empty
        ids, numbers, asking, own = (t.column(c).to_numpy() for t, c in ((rows, "id"), (rows, "row"), (queries, "id"), (queries, "row")))
        data = matrix(rows.column("v"), width)
        asked_rows, floor = matrix(queries.column("v"), width), queries.column("floor").to_numpy()
        parts = [empty]
        for at in range(0, len(own), 512):
            scores = products(asked_rows[at : at + 512], data)
            other = own[at : at + 512, None] != numbers[None, :]
            # Of all rows but the query's own, the k-th score is the least that counts.
            least = np.full(len(scores), -LONG - 1)
            if len(ids) > k:
                least = np.partition(np.where(other, scores, -LONG - 1), len(ids) - k, axis=1)[:, len(ids) - k]
            q, x = np.nonzero(other & (scores >= floor[at : at + 512, None]) & (scores >= least[:, None]))
            value = scores[q, x]
            # ~value falls as value rises, and fits 64 bits.
            order = np.lexsort((ids[x], ~value, q))
            q, x, value = q[order], x[order], value[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, x, value = (a[place < k] for a in (q, x, value))
            parts.append(pa.table({"row": own[at : at + 512][q], "query_id": asking[at : at + 512][q], "vec_id": ids[x], "score": value}))
        return pa.concat_tables(parts)

    keys = ("cell", "chunk", "crowd")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "row bigint, query_id bigint, vec_id bigint, score bigint")
