"""Remove personal data from review text, count what was removed, and scan for leftovers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions import pii


def redact_reviews(reviews: DataFrame, cols: Sequence[str] = ("title", "text")) -> DataFrame:
    """Redacted ``cols``, plus ``redactions`` (count per category) and ``redacted`` (changed or not)."""
    out = reviews.withColumns({f"_{c}": pii.redact(F.col(c)) for c in cols})
    totals = [
        reduce(
            lambda a, b: a + b, (F.coalesce(F.col(f"_{c}").getField(name), F.lit(0)) for c in cols)
        ).alias(name)
        for name in pii.CATEGORIES
    ]
    changed = [~F.col(f"_{c}.text").eqNullSafe(F.col(c)) for c in cols]
    return out.select(
        *(F.col(f"_{c}.text").alias(c) if c in cols else F.col(c) for c in reviews.columns),
        F.struct(*totals).alias("redactions"),
        reduce(lambda a, b: a | b, changed).alias("redacted"),
    )


def redaction_report(redacted: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Reviews seen, reviews changed and replacements per category, per key."""
    return redacted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reviews_in"),
        F.count(F.lit(1)).alias("reviews_out"),
        F.count_if("redacted").alias("fields_touched"),
        F.create_map(
            *(
                part
                for name in pii.CATEGORIES
                for part in (F.lit(name), F.sum(F.col("redactions").getField(name)))
            )
        ).alias("replacements"),
    )


def scan_pii(df: DataFrame, col: str, into: str = "pii_hits") -> DataFrame:
    """Add the personal-data categories still found in ``col``, as ``array<struct<category,hits>>``.

    Hits carry the category and a count, never the matched value.
    """
    return df.withColumn(into, pii.scan(F.col(col)))
