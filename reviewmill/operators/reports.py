"""Assemble weekly report rows from statistics, model prose and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.config import PLAY_STORE
from reviewmill.functions import render
from reviewmill.operators.windows import dated
from reviewmill.scale import attach_small

REPORT_KEY = ["product_id", "week_ending"]
_THEMES = (
    "array<struct<rank:int,id:string,label:string,count_week:bigint,avg_rating_week:double,"
    "trend:string,summary:string>>"
)
_QUOTES = "array<struct<pos:int,text:string,review_id:string,theme_id:string,rating:int,date:date>>"
_ACTIONS = "array<struct<pos:int,title:string,detail:string,theme_id:string>>"


def _listed(rows: DataFrame, into: str, *fields: Column | str) -> DataFrame:
    return rows.groupBy(*REPORT_KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(into))


def with_summaries(top: DataFrame, summaries: DataFrame) -> DataFrame:
    """Top themes with their summary text; the last one given per theme counts, none is ''."""
    last = summaries.groupBy(*REPORT_KEY, "theme_id").agg(F.max_by("summary", "pos").alias("summary"))
    joined = top.join(last, [*REPORT_KEY, "theme_id"], "left")
    return joined.withColumn("summary", F.coalesce(F.col("summary"), F.lit("")))


def resolve_picks(picks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Selected quotes with the text, rating and date of their review; unknown ids vanish."""
    source = reviews.select("product_id", F.col("id").alias("review_id"), "text", "rating", "date")
    return attach_small(source, picks.select(*REPORT_KEY, "pos", "review_id", "theme_id"), ["product_id", "review_id"])


def assemble_reports(
    top: DataFrame,
    summaries: DataFrame,
    picks: DataFrame,
    actions: DataFrame,
    reviews: DataFrame,
    windows: DataFrame,
    product_name: Column | None = None,
) -> DataFrame:
    """One report row per product and week.

    A report holds a few themes, quotes and actions; what grows with the reviews was reduced to
    counts in ``windows`` and ``top`` before.
    """
    themes = _listed(
        with_summaries(top, summaries),
        "top_themes",
        F.col("rank").cast("int").alias("rank"),
        F.col("theme_id").alias("id"),
        "label",
        "count_week",
        "avg_rating_week",
        "trend",
        "summary",
    )
    quotes = _listed(
        resolve_picks(picks, dated(reviews, windows, F.col("corpus_from"), F.col("corpus_to"))),
        "quotes",
        F.col("pos").cast("int").alias("pos"),
        "text",
        "review_id",
        "theme_id",
        "rating",
        "date",
    )
    ideas = _listed(actions, "actions", F.col("pos").cast("int").alias("pos"), "title", "detail", "theme_id")

    def rows(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.array().cast(kind)).alias(name)

    joined = (
        windows.join(themes, REPORT_KEY, "left")
        .join(quotes, REPORT_KEY, "left")
        .join(ideas, REPORT_KEY, "left")
    )
    report = joined.select(
        "product_id",
        (F.col("product_id") if product_name is None else product_name).alias("product_name"),
        "week_ending",
        F.struct(F.col("corpus_from").alias("from"), F.col("corpus_to").alias("to")).alias("corpus_window"),
        F.struct(F.col("reporting_from").alias("from"), F.col("reporting_to").alias("to")).alias(
            "reporting_window"
        ),
        "window_note",
        "review_count_week",
        "review_count_corpus",
        "avg_rating_week",
        F.lit(PLAY_STORE).alias("store"),
        rows("top_themes", _THEMES),
        rows("quotes", _QUOTES),
        rows("actions", _ACTIONS),
    )
    words = render.body_words(F.col("top_themes"), F.col("quotes"), F.col("actions"))
    return report.withColumns(
        {
            "body_word_count": words.cast("int"),
            "doc_url": F.lit(None).cast("string"),
            "draft_id": F.lit(None).cast("string"),
        }
    )


def first_per_theme(items: DataFrame, *fields: str) -> DataFrame:
    """The first quote or action per theme, in list order."""
    return (
        items.groupBy(*REPORT_KEY, "theme_id")
        .agg(F.min_by(F.struct(*fields), "pos").alias("_first"))
        .select(*REPORT_KEY, "theme_id", "_first.*")
    )
