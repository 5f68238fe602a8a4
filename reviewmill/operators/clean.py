"""From raw export rows to unique, dated, English reviews, with the reason for every drop."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, PLAY_STORE
from reviewmill.functions import dates, text
from reviewmill.scale import attach_small

DROP_REASONS = ("empty_text", "short_text", "non_english", "bad_date", "outside_window", "duplicate")

# Store names that count as the Play store when importing a mixed table.
PLAY_NAMES = ("", "play", "play_store", "google_play", "android", "gp")


class EmptyCorpusError(Exception):
    """No reviews remain, so there is nothing to report on."""


def first_present(columns: Sequence[str], *names: str) -> Column:
    """The first of ``names`` found among ``columns`` (case-insensitive), null and absent as ''."""
    by_name = {c.lower(): c for c in columns}
    for name in names:
        if name.lower() in by_name:
            return F.coalesce(F.col(by_name[name.lower()]).cast("string"), F.lit(""))
    return F.lit("")


def is_play_store(store: Column) -> Column:
    """Store whitelist; a missing store counts as Play."""
    return F.lower(F.coalesce(store, F.lit(""))).isin(*PLAY_NAMES)


def project_reviews(
    raw: DataFrame,
    min_words: int = DEFAULT.limits.min_review_words,
    detector: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Typed review columns plus ``drop_reason``: the first failing row test, or null.

    Tests run cheapest first and stop at the first failure, so the language test never sees
    a text that is too short.
    """
    typed = raw.select(
        "product_id",
        F.lit(PLAY_STORE).alias("store"),
        dates.parse_review_date(F.col("date_raw")).alias("date"),
        text.parse_rating(F.col("rating_raw")).alias("rating"),
        F.coalesce(text.strip(F.col("title")), F.lit("")).alias("title"),
        F.coalesce(text.strip(F.col("text")), F.lit("")).alias("text"),
        F.nullif(text.strip(F.col("app_version")), F.lit("")).alias("app_version"),
        "source_file",
        "row_no",
    )
    body = F.col("text")
    reason = (
        F.when(F.length(body) == 0, "empty_text")
        .when(~text.has_words(body, min_words), "short_text")
        .when(~text.is_english(body, detector), "non_english")
        .when(F.col("date").isNull(), "bad_date")
    )
    return typed.withColumn("drop_reason", reason).withColumn(
        "id",
        F.when(
            F.col("drop_reason").isNull(),
            text.review_id(F.col("date"), F.col("rating"), F.col("title"), body),
        ),
    )


def anchor_dates(candidates: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """``week_ending`` per key: the latest usable date before any window is applied."""
    return candidates.groupBy(*keys).agg(F.max("date").alias("week_ending"))


def mark_corpus_window(
    rows: DataFrame,
    corpus_weeks: int = DEFAULT.windows.corpus_weeks,
    week_ending: dt.date | None = None,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Add ``week_ending`` and turn usable rows outside the corpus window into drops.

    The window includes both ends. Its anchor is the given day, a given per-product table, or
    each product's latest usable date.
    """
    if week_ending is not None:
        anchored = rows.withColumn("week_ending", F.lit(week_ending))
    else:
        if anchors is None:
            anchors = anchor_dates(rows.filter(F.col("drop_reason").isNull()))
        anchored = attach_small(rows, anchors, ["product_id"], "left")
    inside = F.col("date").between(
        F.date_sub(F.col("week_ending"), 7 * corpus_weeks), F.col("week_ending")
    )
    return anchored.withColumn(
        "drop_reason",
        F.coalesce("drop_reason", F.when(~F.coalesce(inside, F.lit(False)), "outside_window")),
    )


def deduplicate(
    rows: DataFrame,
    keys: Sequence[str] = ("product_id", "id"),
    order: Sequence[str] = ("date", "source_file", "row_no"),
) -> DataFrame:
    """One row per key, the first in ``order``, plus ``copies``.

    An aggregate rather than a ranking: copies collapse before the shuffle, so one text that
    makes up a third of the table costs one row per input task.
    """
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return (
        rows.groupBy(*keys)
        .agg(first.alias("_row"), F.count(F.lit(1)).alias("copies"))
        .select(*keys, *(F.col("_row").getField(c).alias(c) for c in rest), "copies")
    )


def first_seen(rows: DataFrame, key: str, order: Sequence[str], content: str) -> DataFrame:
    """Drop blank content, keep the first row per ``key``; rows without a key all stay."""
    usable = rows.filter(F.length(text.strip(F.col(content))) > 0)
    keyed = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    unique = deduplicate(usable.filter(keyed), [key], order).drop("copies")
    return unique.unionByName(usable.filter(~keyed))


def mark_duplicates(
    rows: DataFrame,
    row_key: Sequence[str] = ("source_file", "row_no"),
    order: Sequence[str] = ("date", "source_file", "row_no"),
) -> DataFrame:
    """Row-level ``duplicate`` reason for every later copy of an id.

    The kept rows are found by aggregation and matched on the unique row key, so a much-copied
    id never gathers in one task.
    """
    usable = rows.filter(F.col("drop_reason").isNull())
    kept = deduplicate(usable.select("product_id", "id", *dict.fromkeys([*order, *row_key])), order=order)
    kept = kept.select(*row_key, F.lit(True).alias("_kept"))
    return (
        rows.join(kept, list(row_key), "left")
        .withColumn(
            "drop_reason",
            F.coalesce("drop_reason", F.when(F.col("_kept").isNull(), "duplicate")),
        )
        .select(*rows.columns)
    )


def ingest_report(marked: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counters per product: rows read and kept, one count per drop reason, date range."""
    seen = marked.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows_read"),
        *(
            F.count_if(F.col("drop_reason") == reason).alias(f"rows_dropped_{reason}")
            for reason in DROP_REASONS[:-1]
        ),
    )
    kept = reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.sum(F.col("copies") - 1).alias("rows_dropped_duplicate"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    )
    joined = seen.join(kept, "product_id", "left")
    zero = {"rows_kept": 0, "rows_dropped_duplicate": 0}
    return joined.fillna(zero).select(
        "product_id",
        "rows_read",
        "rows_kept",
        *(f"rows_dropped_{reason}" for reason in DROP_REASONS),
        "date_min",
        "date_max",
    )


def require_corpus(reviews: DataFrame) -> DataFrame:
    """Stop instead of reporting on nothing."""
    if reviews.isEmpty():
        raise EmptyCorpusError("no reviews remain after cleaning")
    return reviews


def store_purity(reviews: DataFrame, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """Per key: does any review come from another store?"""
    return reviews.groupBy(*keys).agg(
        F.max(F.col("store") != PLAY_STORE).alias("non_play_data")
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Append the candidate rows of several files, by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def import_rows(table: DataFrame, product_id: Column, source_file: str, row_no: Column) -> DataFrame:
    """Rows of a review-like table as raw reviews: column synonyms, Play rows only, no blank text."""
    names = table.columns
    pick = {
        "store": first_present(names, "store", "source", "platform"),
        "text": first_present(names, "content", "text", "review", "body", "review_text", "reviewText"),
        "title": first_present(names, "title", "review_title", "reviewTitle", "summary"),
        "rating_raw": first_present(names, "score", "rating", "star_rating", "stars"),
        "date_raw": first_present(
            names, "at", "date", "created_at", "review_date", "timestamp", "submitted_at"
        ),
        "app_version": first_present(
            names, "reviewCreatedVersion", "app_version", "version", "appVersion"
        ),
    }
    return (
        table.select(
            product_id.alias("product_id"),
            *(c.alias(name) for name, c in pick.items()),
            F.lit(source_file).alias("source_file"),
            row_no.cast("bigint").alias("row_no"),
        )
        .filter(is_play_store(F.col("store")) & (F.length(text.strip(F.col("text"))) > 0))
        .withColumn("date_raw", dates.normalize_import_time(F.col("date_raw")))
        .drop("store")
    )


def date_range(rows: DataFrame, col: str, keys: Sequence[str] = ("product_id",)) -> DataFrame:
    """First and last value of a date text column."""
    return rows.groupBy(*keys).agg(F.min(col).alias("date_min"), F.max(col).alias("date_max"))
