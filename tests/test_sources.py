import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import clean
from reviewmill.plans.ingest import ingest_reviews
from reviewmill.sources import exports, storage, tables

HEADER = "Review Submit Date and Time,Star Rating,Review Title,Review Text,App Version Name,Reviewer Name"
LONG = "the payment failed and my money left the account again"


def write(folder, name, body):
    path = folder / name
    path.write_bytes(body.encode("utf-8"))
    return path


def load(spark, folder):
    raw, files = exports.read_exports(spark, str(folder), "p")
    return raw, {r.path.rsplit("/", 1)[1]: r.skipped for r in files.collect()}


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    write(tmp_path, "a.csv", f'﻿{HEADER}\n2026-08-30 10:00:00,1,"A, ""B""","{LONG},\nsecond line",3.3,Alice\n2026-08-29,5,,{LONG},,Bob\n')
    raw, _ = load(spark, tmp_path)
    assert raw.columns == ["product_id", "text", "title", "rating_raw", "date_raw", "app_version", "source_file", "row_no"]
    rows = raw.orderBy("row_no").collect()
    assert rows[0].text == f"{LONG},\nsecond line" and rows[0].title == 'A, "B"' and rows[0].date_raw == "2026-08-30 10:00:00"
    assert (rows[1].rating_raw, rows[1].date_raw) == ("5", "2026-08-29")


def test_repeated_header_takes_the_last_column(spark, tmp_path):
    write(tmp_path, "a.csv", f"Date,Text,Date\n2026-01-01,{LONG},2026-02-02\n")
    assert load(spark, tmp_path)[0].first().date_raw == "2026-02-02"


def test_json_list_envelope_and_lines(spark, tmp_path):
    row = {"content": LONG, "at": "2026-08-30", "score": 4, "userName": "x"}
    write(tmp_path, "a.json", json.dumps([row, {**row, "score": None}]))
    write(tmp_path, "b.json", json.dumps({"reviews": [row], "page": 1}))
    write(tmp_path, "c.jsonl", json.dumps(row) + "\n\n" + json.dumps({"content": "only text"}) + "\n")
    raw, files = load(spark, tmp_path)
    by_file = {}
    for r in raw.orderBy("source_file", "row_no").collect():
        by_file.setdefault(r.source_file.rsplit("/", 1)[1], []).append((r.text, r.rating_raw, r.date_raw))
    full = (LONG, "4", "2026-08-30")
    assert by_file == {
        "a.json": [full, (LONG, None, "2026-08-30")],
        "b.json": [full],
        "c.jsonl": [full, ("only text", None, None)],
    }
    assert files == {"a.json": False, "b.json": False, "c.jsonl": False}


def test_app_store_exports_are_skipped_by_name_and_by_header(spark, tmp_path):
    write(tmp_path, "reviews-ios.csv", f"Date,Text\n2026-01-01,{LONG}\n")
    write(tmp_path, "other.csv", f"Review ID,Reviewer Nickname,Rating,Review,Date\n1,x,2,{LONG},2026-01-01\n")
    write(tmp_path, "studios.csv", f"Date,Text\n2026-01-01,{LONG}\n")
    raw, files = load(spark, tmp_path)
    assert files == {"reviews-ios.csv": True, "other.csv": True, "studios.csv": False}
    assert raw.count() == 1


def test_unusable_exports_raise(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("nothing")
    with pytest.raises(exports.ExportError, match="No export file"):
        exports.read_exports(spark, str(tmp_path), "p")
    write(tmp_path, "a.csv", "Date,Stars\n2026-01-01,4\n")
    with pytest.raises(exports.ExportError, match="no text and date"):
        exports.read_exports(spark, str(tmp_path), "p")


def test_known_header_skips_the_header_pass(spark, tmp_path):
    write(tmp_path, "a.csv", f"Date,Text\n2026-01-01,{LONG}\n")
    raw, _ = exports.read_exports(spark, str(tmp_path), "p", multiline=False, csv_header="Date,Text")
    assert raw.first().date_raw == "2026-01-01"


def test_unknown_json_shape_raises(spark, tmp_path):
    write(tmp_path, "a.json", '{"items": []}')
    with pytest.raises(Exception, match="Unsupported JSON shape"):
        exports.read_exports(spark, str(tmp_path), "p")[0].collect()


def fixture_rows():
    """Reviews at two-day steps plus short, foreign, undated, repeated and old ones."""
    end = dt.date(2026, 8, 30)
    rows = [(str(end - dt.timedelta(days=2 * i)), f"{LONG} number {i}", str(1 + i % 5)) for i in range(20)]
    rows += [(str(end), "too short", "1"), (str(end), "la aplicación no funciona en mi teléfono desde hace días", "1")]
    rows += [("someday", f"{LONG} undated", "2"), (str(end), f"{LONG} number 0", "1"), (str(end), "  ", "3")]
    return rows


def test_ingest_counters_and_windows(spark):
    rows = [("p", text, day, " T ", rating, "", "f", i) for i, (day, text, rating) in enumerate(fixture_rows())]
    raw = spark.createDataFrame(
        rows, "product_id string, text string, date_raw string, title string, rating_raw string, app_version string, source_file string, row_no long"
    )
    out = ingest_reviews(raw)
    report = out.report.first().asDict()
    assert {k: v for k, v in report.items() if k.startswith("rows_")} == {
        "rows_read": 25, "rows_kept": 15, "rows_dropped_empty_text": 1, "rows_dropped_short_text": 1,
        "rows_dropped_non_english": 1, "rows_dropped_bad_date": 1, "rows_dropped_outside_window": 5, "rows_dropped_duplicate": 1,
    }
    assert report["week_ending"] == dt.date(2026, 8, 30) and report["corpus_from"] == dt.date(2026, 8, 2)
    assert report["window_note"] is not None and report["review_count_week"] == 14
    assert {r.title for r in out.reviews.collect()} == {"T"}
    early = ingest_reviews(raw, week_ending=dt.date(2026, 8, 10)).report.first()
    assert early.date_max == dt.date(2026, 8, 10)
    reasons = clean.mark_duplicates(clean.mark_corpus_window(clean.project_reviews(raw)))
    assert reasons.filter("drop_reason = 'duplicate'").first().row_no == 23
    with pytest.raises(clean.EmptyCorpusError):
        clean.require_corpus(out.reviews.filter("false"))


def test_review_tables_are_found_and_imported(spark):
    spark.createDataFrame([(1, "x")], "id int, name string").createOrReplaceTempView("aaa_people")
    rows = [(1, LONG, "Android", "1700000000", 4), (2, LONG, "ios", "2026-01-01", 4), (3, " ", "gp", "2026-01-01", 1)]
    spark.createDataFrame(rows, "id int, Content string, Platform string, at string, score int").createOrReplaceTempView("bbb_reviews")
    name = tables.find_review_table(spark, "default")
    got = tables.import_table(spark.table(name), F.lit("p"), name, F.col("id")).collect()
    assert name == "bbb_reviews" and len(got) == 1
    assert (got[0].date_raw, got[0].rating_raw, got[0].title) == ("2023-11-14 22:13:20", "4", "")


def test_csv_export_can_be_read_back(spark, tmp_path):
    raw = spark.createDataFrame([("2026-08-30", "4", "t", f'{LONG} "now"', "1.0")], "date_raw string, rating_raw string, title string, text string, app_version string")
    storage.write_export_csv(raw, str(tmp_path / "out"))
    back, _ = exports.read_exports(spark, str(tmp_path / "out"), "p")
    assert back.first().text == f'{LONG} "now"'
