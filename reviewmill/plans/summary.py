"""One summary row per product and week over all stages of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.reports import REPORT_KEY


def run_summary(
    ingest_report: DataFrame, redaction_report: DataFrame, stats: DataFrame, checked: DataFrame
) -> DataFrame:
    """Counts and windows, replacements, the ranked theme list and the validation outcome."""
    row = F.struct("rank", "theme_id", "count_week", "avg_rating_week", "trend")
    listed = stats.groupBy(*REPORT_KEY).agg(F.array_sort(F.collect_list(row)).alias("themes"))
    return (
        ingest_report.join(redaction_report, "product_id", "left")
        .join(listed, REPORT_KEY, "left")
        .join(checked, REPORT_KEY, "left")
    )
