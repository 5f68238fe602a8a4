"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.scale import cut_lineage


# Links for each task of a round; tables of links are much smaller than the session's usual ones.
LINKS = 50_000


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id.

    Alternating stars: every round hangs a node's larger neighbours, then its smaller ones, under
    the smallest of them, so long chains shorten by half at least. Minima are combined before the
    shuffle; nothing of a node with many neighbours is gathered in one row.
    """
    edges = cut_lineage(_ordered(links.select("a", "b")))
    before = _state(edges)
    while before[0]:
        tasks = -(-before[0] // LINKS)
        edges = cut_lineage(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks).coalesce(tasks))
        now = _state(edges)
        if now == before:
            break
        before = now
    children = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return children.union(children.select(F.col("component").alias("id"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger id to the smaller."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
    hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(hung.coalesce(tasks)).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(hung.union(least.toDF("a", "b")).coalesce(tasks))
