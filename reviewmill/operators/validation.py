"""Quality gate over report rows: every failing code, then pass, fixable and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, PLAY_STORE, Config
from reviewmill.functions import render
from reviewmill.operators.redaction import scan_pii
from reviewmill.operators.reports import REPORT_KEY
from reviewmill.operators.windows import dated, spread_weeks
from reviewmill.scale import attach_small

# Failure codes that stop a report for good.
NOT_FIXABLE = ("NON_PLAY_DATA", "PII_DETECTED")


def quote_checks(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per quote: is it verbatim in its review, and is that review in the window?

    Only reviews of the report's own corpus count. The reviews are read between the days of the
    corpora, and joined on the few ids quoted.
    """
    quotes = reports.select(
        *REPORT_KEY, "reporting_window", "corpus_window", F.explode("quotes").alias("q")
    ).select(
        *REPORT_KEY,
        "reporting_window",
        "corpus_window",
        F.col("q.pos").alias("pos"),
        F.col("q.review_id").alias("review_id"),
        F.col("q.text").alias("quote"),
    )
    wanted = quotes.select("product_id", "review_id").distinct()
    near = dated(reviews, reports, F.col("corpus_window.from"), F.col("corpus_window.to"))
    source = near.select(
        "product_id",
        F.col("id").alias("review_id"),
        F.concat(F.col("title"), F.lit("\n"), F.col("text")).alias("source"),
        "date",
    )
    found = attach_small(source, wanted, ["product_id", "review_id"])
    joined = quotes.join(found, ["product_id", "review_id"], "left")
    corpus, window = F.col("corpus_window"), F.col("reporting_window")
    known = F.col("date").between(corpus["from"], corpus["to"])
    return joined.select(
        *REPORT_KEY,
        "pos",
        "review_id",
        (~F.coalesce(known & F.contains(F.col("source"), F.col("quote")), F.lit(False))).alias("not_verbatim"),
        F.coalesce(known & ~F.col("date").between(window["from"], window["to"]), F.lit(False)).alias("out_of_window"),
    )


def foreign_store(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """The reports (product, week) whose corpus holds a review from another store."""
    window = F.col("corpus_window")
    days = spread_weeks(
        reports.select(*REPORT_KEY, window["from"].alias("_from"), window["to"].alias("_to")).filter("_from <= _to"),
        F.col("_from"),
        F.col("_to"),
    )
    near = dated(reviews, reports, window["from"], window["to"])
    foreign = near.filter(F.col("store") != PLAY_STORE).select("product_id", "date").distinct()
    found = days.join(foreign, ["product_id", "date"]).select(*REPORT_KEY).distinct()
    return found.withColumn("non_play_data", F.lit(True))


def stray_action(actions: Column, top_themes: Column) -> Column:
    """Is there an action on a theme that isn't one of the report's top themes?"""
    ids = F.transform(top_themes, lambda t: t["id"])
    return F.exists(actions, lambda a: ~F.array_contains(ids, a["theme_id"]))


def _codes(*pairs: tuple[Column, Column | str]) -> Column:
    named = [F.when(flag, F.lit(code) if isinstance(code, str) else code) for flag, code in pairs]
    return F.array_distinct(F.array_compact(F.array(*named)))


def validate_reports(
    reports: DataFrame,
    reviews: DataFrame,
    themes: DataFrame,
    cfg: Config = DEFAULT,
    md: Column | None = None,
) -> DataFrame:
    """Validation row per report: all failing codes in order, hits, and whether a retry can help.

    ``themes`` holds every theme of each report (before the top ones were chosen). ``md`` is the
    rendered text to scan for personal data.
    """
    stray = stray_action(F.col("actions"), F.col("top_themes"))
    flagged = reports.select(
        *REPORT_KEY,
        render.body_words(F.col("top_themes"), F.col("quotes"), F.col("actions")).cast("int").alias("body_word_count"),
        (F.size("top_themes") != cfg.themes.highlight).alias("theme_count"),
        (F.size("quotes") != cfg.note.quote_count).alias("quote_count"),
        ((F.size("actions") != cfg.note.action_count) | stray).alias("action_count"),
        (render.report_markdown() if md is None else md).alias("md"),
    )
    theme_total = themes.groupBy(*REPORT_KEY).agg(F.count(F.lit(1)).alias("theme_total"))
    # Quote codes appear in the order the quotes raise them, verbatim before window.
    quotes = quote_checks(reports, reviews).groupBy(*REPORT_KEY).agg(
        F.min(F.when(F.col("not_verbatim"), F.col("pos") * 2)).alias("not_verbatim_at"),
        F.min(F.when(F.col("out_of_window"), F.col("pos") * 2 + 1)).alias("out_of_window_at"),
    )
    joined = (
        scan_pii(flagged, "md")
        .join(theme_total, REPORT_KEY, "left")
        .join(quotes, REPORT_KEY, "left")
        .join(foreign_store(reports, reviews), REPORT_KEY, "left")
    )
    verbatim, window = F.col("not_verbatim_at"), F.col("out_of_window_at")
    window_first = F.coalesce(window < verbatim, F.lit(False))
    failures = _codes(
        (F.col("body_word_count") > cfg.note.max_words, "WORD_LIMIT"),
        (F.col("theme_count"), "THEME_COUNT"),
        (F.coalesce(F.col("theme_total") > cfg.themes.max_total, F.lit(False)), "THEME_CAP"),
        (F.col("quote_count"), "QUOTE_COUNT"),
        (F.col("action_count"), "ACTION_COUNT"),
        (window_first, "QUOTE_OUT_OF_WINDOW"),
        (verbatim.isNotNull(), "QUOTE_NOT_VERBATIM"),
        (window.isNotNull(), "QUOTE_OUT_OF_WINDOW"),
        (F.coalesce(F.col("non_play_data"), F.lit(False)), "NON_PLAY_DATA"),
        (F.size("pii_hits") > 0, "PII_DETECTED"),
    )
    return joined.select(*REPORT_KEY, "body_word_count", failures.alias("failures"), "pii_hits").withColumns(
        {
            "passed": F.size("failures") == 0,
            "fixable": ~F.arrays_overlap("failures", F.array(*(F.lit(c) for c in NOT_FIXABLE))),
        }
    )


def route(passed: Column, fixable: Column, attempts: Column, max_attempts: int) -> Column:
    """What follows a validation: publish, retry or abort."""
    return (
        F.when(passed, "publish")
        .when(~fixable | (attempts >= max_attempts), "abort")
        .otherwise("retry_generate")
    )


def final_status(passed: Column, fixable: Column, attempts: Column, max_attempts: int) -> Column:
    return (
        F.when(passed, "passed")
        .when(~fixable, "aborted_non_fixable")
        .when(attempts >= max_attempts, "aborted_attempts_exhausted")
        .otherwise("pending")
    )


def run_status(exit_code: Column) -> Column:
    """Status text of a finished run's exit code."""
    return (
        F.when(exit_code == 0, "ok")
        .when(exit_code == 2, "empty_corpus")
        .when(exit_code == 3, "validate_abort")
        .when(exit_code == 4, "publish_failed")
        .when(exit_code == 5, "lock_busy")
        .otherwise("failed")
    )


def failure_history(attempts: DataFrame) -> DataFrame:
    """The code lists of all attempts per report, in attempt order."""
    listed = F.array_sort(F.collect_list(F.struct("attempt", "failures")))
    return attempts.groupBy(*REPORT_KEY).agg(listed.alias("_a")).select(
        *REPORT_KEY, F.col("_a.failures").alias("failure_history")
    )
