import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT
from reviewmill.functions import render
from reviewmill.operators import periods, reports, validation
from reviewmill.sources import storage, tables

WEEK = dt.date(2026, 9, 20)
KEY = "product_id string, week_ending date, "


def make_report(spark, quote="It is slow and it crashes every day", actions=1, note=None):
    windows = spark.createDataFrame(
        [("p", WEEK, WEEK - dt.timedelta(28), WEEK, WEEK - dt.timedelta(6), WEEK, note, 12, 1042, 2.65)],
        KEY + "corpus_from date, corpus_to date, reporting_from date, reporting_to date, window_note string, "
        "review_count_week long, review_count_corpus long, avg_rating_week double",
    )
    top = spark.createDataFrame(
        [("p", WEEK, "kyc", "KYC", 7, 2.35, "rising", 1), ("p", WEEK, "pay", "Payments", 5, None, "steady", 2)],
        KEY + "theme_id string, label string, count_week long, avg_rating_week double, trend string, rank int",
    )
    summaries = spark.createDataFrame([("p", WEEK, "kyc", "Old.", 1), ("p", WEEK, "kyc", "KYC **fails** often.", 2)], KEY + "theme_id string, summary string, pos int")
    picks = spark.createDataFrame([("p", WEEK, 1, "kyc", "r1"), ("p", WEEK, 2, "kyc", "gone")], KEY + "pos int, theme_id string, review_id string")
    ideas = spark.createDataFrame([("p", WEEK, i, "kyc", "Fix KYC", "Retry uploads.") for i in range(1, actions + 1)], KEY + "pos int, theme_id string, title string, detail string")
    reviews = spark.createDataFrame(
        [("p", "r1", "play_store", WEEK, 1, "Bad", quote), ("p", "r2", "play_store", WEEK, 1, "", "x")],
        "product_id string, id string, store string, date date, rating int, title string, text string",
    )
    return reviews, top, reports.assemble_reports(top, summaries, picks, ideas, reviews, windows, F.lit("Acme"))


def test_markdown_and_words(spark):
    _, _, rows = make_report(spark, note="4-week rollup (low weekly volume)")
    row = rows.withColumn("md", render.report_markdown("Title", "com.acme")).first()
    assert row.md == (
        "# Title — Acme — week ending 2026-09-20\n"
        "Play Store · com.acme · 12 reviews · 14–20 Sep · avg 2.6★ (corpus: 1,042 reviews / 4 weeks)\n"
        "*4-week rollup (low weekly volume)*\n\n"
        "## Top themes\n"
        "1. **KYC — 7 reviews, avg 2.4★, ↑ rising.** KYC **fails** often.\n"
        "2. **Payments — 5 reviews, avg n/a, → steady.** \n\n"
        "## What users said\n"
        '> "It is slow and it crashes every day"\n\n'
        "## Action ideas\n"
        "1. **Fix KYC.** Retry uploads.\n"
    )
    assert row.body_word_count == 3 + 8 + 4


def test_letter_and_append_block(spark):
    row = make_report(spark)[2].withColumns(
        {"letter": render.summary_letter("Title"), "block": render.append_block(F.lit("body \n"), F.col("week_ending"), "Log {week_ending}")}
    ).first()
    assert "1. KYC\n   KYC **fails** often.\n\n2. Payments\n   No summary available.\n\nAction items\n1. Fix KYC\n   Retry uploads.\n" in row.letter
    assert "average rating 2.6★ · 12 Play Store reviews" in row.letter
    assert row.block == "\n\n---\n\n# Log 2026-09-20\n\nbody\n"


def check(spark, rows, reviews, top, **note):
    cfg = replace(DEFAULT, themes=replace(DEFAULT.themes, highlight=2), note=replace(DEFAULT.note, quote_count=1, action_count=1, **note))
    return validation.validate_reports(rows, reviews, top, cfg).first()


def test_sound_report_passes(spark):
    reviews, top, rows = make_report(spark)
    got = check(spark, rows, reviews, top)
    assert (got.passed, got.fixable, got.failures) == (True, True, [])


@pytest.mark.parametrize(
    "change, code, fixable",
    [
        (lambda d: d.withColumn("quotes", F.transform("quotes", lambda q: q.withField("text", F.lit("made up")))), "QUOTE_NOT_VERBATIM", True),
        (lambda d: d.withColumn("reporting_window", F.struct(F.lit(WEEK).alias("from"), F.lit(WEEK).alias("to"))).withColumn(
            "reporting_window", F.transform(F.array("reporting_window"), lambda w: w.withField("to", F.date_sub(w["to"], 1)))[0]), "QUOTE_OUT_OF_WINDOW", True),
        (lambda d: d.withColumn("actions", F.transform("actions", lambda a: a.withField("theme_id", F.lit("x")))), "ACTION_COUNT", True),
        (lambda d: d.withColumn("quotes", F.slice("quotes", 1, 0)), "QUOTE_COUNT", True),
        (lambda d: d.withColumn("top_themes", F.slice("top_themes", 1, 1)), "THEME_COUNT", True),
        (lambda d: d.withColumn("product_name", F.lit("mail a@b.io")), "PII_DETECTED", False),
    ],
)
def test_each_failure(spark, change, code, fixable):
    reviews, top, rows = make_report(spark)
    got = check(spark, change(rows), reviews, top)
    assert (got.passed, got.fixable, got.failures) == (False, fixable, [code])


def test_word_limit_and_foreign_store(spark):
    reviews, top, rows = make_report(spark)
    got = check(spark, rows, reviews.withColumn("store", F.lit("app_store")), top, max_words=5)
    assert got.failures == ["WORD_LIMIT", "NON_PLAY_DATA"] and not got.fixable


def archived(spark, weeks, product="p", url=None):
    _, _, rows = make_report(spark)
    out = None
    for week in weeks:
        one = rows.withColumns({"week_ending": F.lit(week), "product_id": F.lit(product), "doc_url": F.lit(url), "md": F.lit("text")})
        out = one if out is None else out.unionByName(one)
    return out


def test_archive_upsert_and_lookup(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert storage.load_archive(spark, path).count() == 0
    older = WEEK - dt.timedelta(7)
    storage.archive_reports(archived(spark, [older, WEEK]), path)
    storage.archive_reports(archived(spark, [WEEK], "q"), path)
    storage.archive_reports(archived(spark, [WEEK], url="new"), path)
    rows = {(r.product_id, r.week_ending): r.doc_url for r in storage.load_archive(spark, path).collect()}
    assert rows == {("p", older): None, ("p", WEEK): "new", ("q", WEEK): None}
    assert {r.week_ending for r in storage.load_report(spark, path).collect()} == {WEEK}
    assert storage.load_report(spark, path, "2026-W37").count() == 0
    found = storage.load_report(spark, path, str(older))
    assert found.count() == 1 and "PartitionFilters: [isnotnull(week_ending" in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        storage.archive_reports(archived(spark, [None]).withColumn("week_ending", F.lit(None).cast("date")), path)


def test_period_slots_fill_gaps(spark):
    weeks = [WEEK, WEEK - dt.timedelta(8)]
    rows = spark.createDataFrame([("p", w) for w in weeks], "product_id string, week_ending date")
    products = spark.createDataFrame([("p",), ("empty",)], "product_id string")
    got = periods.period_weeks(rows, products=products, today=dt.date(2026, 9, 24)).orderBy("product_id", "slot").collect()
    mine = [r for r in got if r.product_id == "p"]
    assert [r.week_ending for r in mine] == [*weeks, WEEK - dt.timedelta(7), WEEK - dt.timedelta(14)]
    assert [r.available for r in mine] == [True, True, False, False] and mine[0].is_latest
    assert mine[0].label == "Sep 14 – 20, 2026" and mine[0].iso_week == "2026-W38"
    assert got[0].week_ending == dt.date(2026, 9, 19) and not got[0].available


def test_registry(spark, tmp_path):
    assert tables.load_registry(spark, str(tmp_path / "none")).count() == 0
    schema = "product_id string, week_ending string, document_id string"
    registry = spark.createDataFrame([("p", "2026-09-13", "a"), ("p", "_default", "d")], schema)
    published = spark.createDataFrame([("p", WEEK, "b")], "product_id string, week_ending date, document_id string")
    path = str(tmp_path / "registry")
    storage.save_registry(periods.registry_upsert(registry, published), path)
    saved = tables.load_registry(spark, path)
    weeks = spark.createDataFrame([("p", WEEK), ("p", dt.date(2026, 9, 27))], "product_id string, week_ending date")
    assert [r.document_id for r in periods.resolve_document(weeks, saved).orderBy("week_ending").collect()] == ["b", "d"]
    assert [r.week_ending for r in periods.pending_weeks(weeks, saved).collect()] == [dt.date(2026, 9, 27)]


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for status in ("ok", "failed"):
        storage.append_run_log(spark.createDataFrame([(status,)], "status string"), path)
    assert spark.read.json(path).count() == 2
