"""Positions in corpus order without sorting a whole product in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.scale import attach_small, cut_lineage

# Row numbers carry their partition above this bit.
_PARTITION_BIT = 33


def corpus_position(
    reviews: DataFrame,
    keys: Sequence[str] = ("product_id",),
    date_col: str = "date",
    id_col: str = "id",
    into: str = "pos",
) -> DataFrame:
    """Add the 0-based position of each row in (date, id) order within ``keys``.

    Rows are dealt by ranges of (keys, date, id), whose bounds Spark samples, and sorted within their
    range, so neither a hot product nor a crowded day nor a plain id scheme fills one task. A row's
    number within its partition, less the first one of its key there, plus the key's rows in earlier
    partitions, is its position. The dealt rows are stored, so that numbers and counts are of the same
    partitions; there is a count per key and partition it reaches into. Rows equal in all three columns
    share a partition and are numbered in any order.
    """
    order = [*keys, date_col, id_col]
    dealt = reviews.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.col("_at")
    rows = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    # A struct of keys joins null keys too.
    rows = rows.withColumns({"_key": F.struct(*keys), "_part": F.shiftright(at, _PARTITION_BIT)})
    runs = rows.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    starts = runs.select("_key", "_part", (before - F.col("_first")).alias("_start"))
    joined = attach_small(rows, starts, ["_key", "_part"])
    return joined.select(*reviews.columns, (at + F.col("_start")).cast("bigint").alias(into))
