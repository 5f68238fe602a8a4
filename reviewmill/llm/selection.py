"""Exact selection of the k first rows of a table of any size, without sorting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest(rows: DataFrame, k: int, keys: list[str]) -> Column:
    """Condition for the ``k`` rows with the largest whole-number ``keys``, the first key first.

    Digits of 16 bits are counted from the top, so at most 65,536 counts come to the driver at a
    time. Rows equal in all keys go together: all of them stay if the k-th is among them. Keys have
    no nulls.
    """
    if k <= 0:
        return F.lit(False)
    kept, equal = F.lit(False), F.lit(True)
    left = k
    for key in keys:
        prefix = None
        for shift in (48, 32, 16, 0):
            same = equal if prefix is None else equal & (F.shiftright(key, shift + 16) == prefix)
            counts = rows.where(same).groupBy(F.shiftright(key, shift).alias("d")).count().collect()
            for digit, n in sorted(((r["d"], r["count"]) for r in counts), reverse=True):
                if n >= left:
                    prefix = digit
                    break
                left -= n
            else:
                return F.lit(True) if prefix is None and key == keys[0] else kept | same
        kept = kept | (equal & (F.col(key) > prefix))
        equal = equal & (F.col(key) == prefix)
    return kept | equal
