"""Joins by document id that send small sides whole, after counting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.scale import cut_lineage

# Rows of a few numbers (8 bytes each) up to which a table of ids is sent to every executor.
BROADCAST_IDS = 4_000_000


def small(rows: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows, stored, and marked for broadcast if they are at most ``limit``."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= limit else rows


def only_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is in ``ids``, a table of that column alone."""
    return rows.join(small(ids), column, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id isn't in ``ids``; rows without an id stay."""
    return rows.join(small(ids.where(F.col(column).isNotNull())), column, "left_anti")
