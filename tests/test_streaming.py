import json

from pyspark.sql import functions as F

from reviewmill.streaming.incremental import stream_ingest, weekly_counts

LONG = "the payment failed and my money left the account again"


def land(folder, name, rows):
    lines = [
        json.dumps({"product_id": "p", "text": t, "date_raw": d, "title": "", "rating_raw": "2", "source_file": name, "row_no": i})
        for i, (d, t) in enumerate(rows)
    ]
    (folder / name).write_text("\n".join(lines))


def test_each_review_is_appended_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    land(landing, "a.json", [("2026-08-30", LONG), ("2026-08-30", LONG), ("2026-08-30", "short"), ("2026-08-01", f"{LONG} call 98765 43210")])
    stream_ingest(spark, str(landing), out, state).awaitTermination(60)
    land(landing, "b.json", [("2026-08-30", LONG), ("2026-01-01", f"{LONG} late")])
    stream_ingest(spark, str(landing), out, state).awaitTermination(60)
    rows = spark.read.parquet(out).orderBy("date").collect()
    assert [r.text for r in rows] == [f"{LONG} late", f"{LONG} call [phone]", LONG]
    assert str(rows[2].week_start) == "2026-08-24"


def test_weekly_counts_start_on_monday(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.sql("SELECT 'p' AS product_id, DATE '2026-08-30' AS date, 4 AS rating UNION ALL SELECT 'p', DATE '2026-08-31', NULL").write.parquet(path)
    stream = spark.readStream.schema("product_id string, date date, rating int").parquet(path)
    query = weekly_counts(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("weekly").select("n", F.col("window.start").cast("date").cast("string").alias("d")).collect()
    assert {(r.d, r.n) for r in rows} == {("2026-08-24", 1), ("2026-08-31", 1)}
