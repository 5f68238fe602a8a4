"""Time headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from reviewmill.plans.queries import QUERIES
from reviewmill.session import local_session

HEADLINE = (
    "text_signals",
    "ingested_reviews",
    "ingest_report",
    "dedup_reviews",
    "corpus_order",
    "reporting_windows",
    "theme_statistics",
    "weekly_backfill",
    "top_themes",
    "theme_member_lists",
    "redacted_reviews",
    "redacted_contacts",
    "built_themes",
    "scored_assignments",
    "quote_pool",
    "document_quote_pool",
    "report_markdown",
    "report_validation",
    "period_slots",
    "table_import",
)


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{data}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": data}))
    spark.stop()


if __name__ == "__main__":
    main()
