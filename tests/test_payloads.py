import datetime as dt
import json

from pyspark.sql import functions as F

from reviewmill.functions import render
from reviewmill.operators import payloads

WEEK = dt.date(2026, 8, 30)
D = dt.date


def test_theme_and_quote_payloads(spark):
    top = spark.createDataFrame(
        [("p", WEEK, "b", "B", 3, None, "steady", 2), ("p", WEEK, "a", "A", 5, 2.5, "rising", 1)],
        "product_id string, week_ending date, theme_id string, label string, count_week long, avg_rating_week double, trend string, rank int",
    )
    themes = json.loads(payloads.theme_payload(top).first().themes_json)
    assert [t["theme_id"] for t in themes] == ["a", "b"] and themes[1]["avg_rating_week"] is None
    pool = spark.createDataFrame(
        [("p", WEEK, "b", "r3", "three", 1, 1), ("p", WEEK, "a", "r2", 'say "two"', None, 2), ("p", WEEK, "a", "r1", "one", 4, 1)],
        "product_id string, week_ending date, theme_id string, id string, text string, rating int, rank int",
    )
    quotes = json.loads(payloads.quote_payload(pool).first().quotes_json)
    assert quotes == {
        "a": [{"review_id": "r1", "text": "one", "rating": 4}, {"review_id": "r2", "text": 'say "two"', "rating": None}],
        "b": [{"review_id": "r3", "text": "three", "rating": 1}],
    }


def test_batches_hold_shortened_texts(spark):
    rows = [("p", f"{i:03d}", WEEK, "x" * (115 + i), None) for i in range(12)]
    reviews = spark.createDataFrame(rows, "product_id string, id string, date date, text string, rating int")
    got = [json.loads(r.payload) for r in payloads.batch_payloads(reviews).orderBy("batch_no").collect()]
    assert [len(batch) for batch in got] == [10, 2]
    assert got[0][0] == {"review_id": "000", "text": "x" * 115, "rating": None}
    assert got[1][1]["text"] == "x" * 119 + "…"


def test_unusable_replies_yield_nothing(spark):
    good = '[{"review_id":"a","theme_id":"kyc","confidence":0.5}]'
    replies = [good, f"```json\n{good}\n```", '{"assignments":' + good + "}", "no json", good.replace("0.5", "2.0"),
               '[{"review_id":"a","theme_id":"kyc"}]', "", None]
    frame = spark.createDataFrame([("p", i, r) for i, r in enumerate(replies)], "product_id string, batch_no long, reply string")
    got = payloads.parse_replies(frame).orderBy("batch_no").collect()
    assert [(r.batch_no, r.review_id, r.theme_id, r.confidence, r.pos) for r in got] == [(i, "a", "kyc", 0.5, 0) for i in range(3)]


def test_corpus_weeks_shown(spark):
    spans = [(D(2026, 8, 2), WEEK), (D(2026, 8, 30), WEEK), (D(2026, 8, 19), WEEK)]
    rows = spark.createDataFrame(spans, "a date, b date").select(render.corpus_weeks(F.col("a"), F.col("b")).alias("w"))
    assert [r.w for r in rows.collect()] == [4, 1, 2]
