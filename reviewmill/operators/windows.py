"""Corpus and reporting windows, from a daily rollup that is small whatever the review count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, ROLLUP_NOTE, WindowConfig
from reviewmill.functions.numbers import ratio_2dp
from reviewmill.scale import attach_small


def daily_rollup(reviews: DataFrame, keys: Sequence[str] = ("product_id",), **more: Column) -> DataFrame:
    """Reviews, rated reviews and rating sum per key and day, plus any ``more`` aggregates.

    Every count and average of a window is a sum over days, so this is the only shuffle the
    reviews need, and it is combined before it. A hot product or theme is a few rows per task.
    """
    return reviews.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rating").alias("rated"),
        F.coalesce(F.sum("rating"), F.lit(0)).cast("bigint").alias("rating_sum"),
        *(c.alias(name) for name, c in more.items()),
    )


def spread_weeks(weeks: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per week and day of its span, so windows join on equal dates, not on ranges."""
    return weeks.withColumn("date", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def compute_windows(
    daily: DataFrame, weeks: DataFrame, cfg: WindowConfig = DEFAULT.windows
) -> DataFrame:
    """Windows per (product, week_ending), for any number of weeks at once.

    A week with fewer than ``min_week_reviews`` reviews falls back to ``fallback_days`` and
    carries a note. The trend later still compares that count with a weekly baseline.
    """
    end = F.col("week_ending")
    corpus_from = F.date_sub(end, 7 * cfg.corpus_weeks)
    week_from = F.date_sub(end, cfg.reporting_days - 1)
    roll_from = F.date_sub(end, cfg.fallback_days - 1)
    keyed = weeks.select("product_id", "week_ending").distinct()
    days = spread_weeks(keyed, F.least(corpus_from, week_from, roll_from), end)
    per_day = daily.groupBy("product_id", "date").agg(
        F.sum("n").alias("n"), F.sum("rated").alias("rated"), F.sum("rating_sum").alias("rating_sum")
    )

    def total(col: str, since: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("date") >= since, F.col(col))), F.lit(0)).cast("bigint")

    counted = (
        days.join(per_day, ["product_id", "date"], "left")
        .groupBy("product_id", "week_ending")
        .agg(
            total("n", corpus_from).alias("review_count_corpus"),
            total("n", week_from).alias("_week"),
            total("n", roll_from).alias("_roll"),
            total("rated", week_from).alias("_week_rated"),
            total("rated", roll_from).alias("_roll_rated"),
            total("rating_sum", week_from).alias("_week_sum"),
            total("rating_sum", roll_from).alias("_roll_sum"),
        )
    )
    thin = F.col("_week") < cfg.min_week_reviews

    def pick(week: str, roll: str) -> Column:
        return F.when(thin, F.col(roll)).otherwise(F.col(week))

    return counted.select(
        "product_id",
        "week_ending",
        corpus_from.alias("corpus_from"),
        end.alias("corpus_to"),
        F.when(thin, roll_from).otherwise(week_from).alias("reporting_from"),
        end.alias("reporting_to"),
        F.when(thin, F.lit(ROLLUP_NOTE)).alias("window_note"),
        pick("_week", "_roll").alias("review_count_week"),
        "review_count_corpus",
        ratio_2dp(pick("_week_sum", "_roll_sum"), pick("_week_rated", "_roll_rated")).alias(
            "avg_rating_week"
        ),
    )


def dated(reviews: DataFrame, weeks: DataFrame, first: Column, last: Column) -> DataFrame:
    """Reviews between the first and last day any week needs, as literal bounds a scan can prune by."""
    low, high = weeks.agg(F.min(first), F.max(last)).first()
    if low is None:
        return reviews.limit(0)
    return reviews.filter(F.col("date").between(F.lit(low), F.lit(high)))


def in_window(reviews: DataFrame, windows: DataFrame, kind: str = "reporting") -> DataFrame:
    """Reviews paired with every week whose window holds their date, as an equi-join on days."""
    days = spread_weeks(
        windows.select("product_id", "week_ending", f"{kind}_from", f"{kind}_to"),
        F.col(f"{kind}_from"),
        F.col(f"{kind}_to"),
    ).select("product_id", "week_ending", "date")
    near = dated(reviews, windows, F.col(f"{kind}_from"), F.col(f"{kind}_to"))
    return attach_small(near, days, ["product_id", "date"])
