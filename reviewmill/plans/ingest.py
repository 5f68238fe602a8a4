"""Raw export rows to clean reviews, windows and a report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, Config
from reviewmill.operators import clean
from reviewmill.operators.windows import compute_windows, daily_rollup
from reviewmill.scale import stored


@dataclass(frozen=True)
class Ingested:
    reviews: DataFrame  # unique reviews of the corpus window, with their number of copies
    report: DataFrame  # counters and windows per product
    windows: DataFrame  # one row per (product_id, week_ending)


def ingest_reviews(
    raw: DataFrame,
    cfg: Config = DEFAULT,
    week_ending: dt.date | None = None,
    detector: Callable[[Column], Column] | None = None,
    store: Callable[[DataFrame], DataFrame] = stored,
    stage: Callable[[DataFrame], DataFrame] = stored,
) -> Ingested:
    """Clean, window and de-duplicate raw rows of any number of products.

    Raw rows are read and cleaned once, into the table that ``stage`` writes: rows that stay with all
    their columns, the others with the reason alone. Anchor dates and counters read three narrow columns
    of it. Windowing comes before de-duplication, so only corpus rows are shuffled. ``store`` writes the
    unique reviews and returns them as read back, for windows, report and later stages.
    """
    cleaned = clean.project_reviews(raw, cfg.limits.min_review_words, detector)
    kept = F.col("drop_reason").isNull()
    content = ("rating", "title", "text", "app_version", "source_file", "row_no")
    rows = stage(cleaned.withColumns({c: F.when(kept, F.col(c)) for c in content}))
    if week_ending is None:
        weeks = clean.anchor_dates(rows.filter(F.col("drop_reason").isNull()))
    else:
        weeks = rows.groupBy("product_id").agg(F.lit(week_ending).alias("week_ending"))
    marked = clean.mark_corpus_window(rows, cfg.windows.corpus_weeks, week_ending, weeks)
    usable = marked.filter(F.col("drop_reason").isNull()).drop("drop_reason")
    unique = store(clean.deduplicate(usable))
    windows = compute_windows(daily_rollup(unique), weeks, cfg.windows)
    counters = clean.ingest_report(marked, unique)
    shown = windows.select(
        "product_id",
        "week_ending",
        "corpus_from",
        "corpus_to",
        "reporting_from",
        "reporting_to",
        "window_note",
        "review_count_week",
    )
    return Ingested(
        reviews=unique.drop("week_ending"),
        report=counters.join(shown, "product_id", "left"),
        windows=windows,
    )
