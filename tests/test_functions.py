import datetime as dt
import random

from pyspark.sql import functions as F

from reviewmill.functions import dates, numbers, render, text

D = dt.date


def test_review_dates(values):
    cases = {
        "2026-08-30": D(2026, 8, 30),
        " 2026-08-30 ": D(2026, 8, 30),
        "2026-02-30": None,
        "0000-01-01": None,
        "2026-08-30 10:00:00": D(2026, 8, 30),
        "2026-8-3 1:2:3": D(2026, 8, 3),
        "2026-08-30 10:00": None,
        "2026-08-30 25:00:00": None,
        "2026-08-30 10:00:60": None,
        "2026-08-30 10:00:00.123": D(2026, 8, 30),
        "2026-08-30T10:00:00Z": D(2026, 8, 30),
        "2026-08-30T23:30:00+05:30": D(2026, 8, 30),
        "20260830T101010Z": D(2026, 8, 30),
        "20260830": None,
        "8/30/2026": D(2026, 8, 30),
        "30/8/2026": D(2026, 8, 30),
        "3/4/2026": D(2026, 3, 4),
        "02/30/2026": None,
        "2026/8/30": D(2026, 8, 30),
        "Aug 30, 2026": D(2026, 8, 30),
        "OCT 3, 2026": D(2026, 10, 3),
        "Sept 3, 2026": None,
        "2026-8-3": None,
        "1693400000": None,
        "2026-W35-1": D(2026, 8, 24),
        "2026-W54-1": None,
        "": None,
        None: None,
    }
    assert values(list(cases), dates.parse_review_date) == list(cases.values())


def test_import_times(values):
    cases = {
        "2026-08-30 10:00:00": "2026-08-30 10:00:00",
        "2026-08-30T10:00:00Z": "2026-08-30 10:00:00",
        "2026-08-30T10:00:00.123Z": "2026-08-30 10:00:00",
        "2026-08-30": "2026-08-30 00:00:00",
        "30-08-2026": "2026-08-30 00:00:00",
        "1700000000": "2023-11-14 22:13:20",
        "1700000000000": "2023-11-14 22:13:20",
        "yesterday": "yesterday",
        "2026-02-30": "2026-02-30",
        "": "",
    }
    assert values(list(cases), dates.normalize_import_time) == list(cases.values())


def test_ratings(values):
    cases = {"4": 4, "4.9": 4, "0.9": None, " 5 ": 5, "6": None, "1e0": 1, "nan": None, "inf": None, "4d": None,
             "": None, "+3": 3, "2.": 2, "-1": None, None: None}
    assert values(list(cases), text.parse_rating) == list(cases.values())


def test_rounding_equals_correctly_rounded_decimals(spark):
    pairs = [(s, n) for n in range(1, 201) for s in range(n, 5 * n + 1, max(1, n // 30))]
    rows = spark.createDataFrame(pairs, "s long, n long").withColumn("mean", numbers.ratio_2dp(F.col("s"), F.col("n")))
    rows = rows.withColumn("short", numbers.one_decimal(F.col("mean")))
    for r in rows.collect():
        assert r.mean == round(r.s / r.n, 2)
        assert r.short == f"{r.mean:.1f}"
    assert spark.range(1).select(numbers.ratio_2dp(F.lit(1), F.lit(0)).alias("x")).first().x is None


def test_half_goes_up_for_display(values):
    assert values([2.25, 2.75, 2.35, None], render.rating_text, "double") == ["2.3", "2.8", "2.4", "n/a"]


def test_words_and_trimming(values):
    rng = random.Random(1)
    alphabet = "ab Z9_-.\t\n\xa0 é日²Ⅷ\x1c#*"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    words = [sum(any(ch.isalnum() for ch in token) for token in t.split()) for t in texts]
    assert values(texts, text.word_count) == words
    assert values(texts, text.strip) == [t.strip() for t in texts]
    assert values(texts, lambda c: text.has_words(c, 3)) == [n >= 3 for n in words]


def test_english_by_letters(values):
    cases = {
        "the app keeps crashing on login": True,
        "l'application se ferme déjà": False,
        "ऐप बहुत अच्छा है": False,
        "1234567 !!!": False,
        "abcdefg": False,
        "abcdefgh": True,
        "": False,
    }
    assert values(list(cases), text.is_english) == list(cases.values())


def test_detector_decides_where_it_answers(values):
    def detector(c):
        return F.when(c.startswith("le"), F.struct(F.lit("fr").alias("lang"), F.lit(0.9).alias("prob"))).when(
            c.startswith("the"), F.struct(F.lit("en").alias("lang"), F.lit(0.4).alias("prob"))
        )

    texts = ["le service est lent", "the service is slow", "it is a slow service"]
    assert values(texts, lambda c: text.is_english(c, detector)) == [False, False, True]


def test_truncate_slug_and_labels(values):
    assert values(["  abcdef  ", "abcd efgh", "abc"], lambda c: text.truncate(c, 6)) == ["abcdef", "abcd…", "abc"]
    assert values([" App Speed "], text.slug) == ["app_speed"]
    assert values(["kyc", "other", "app_speed"], lambda c: text.theme_label(c, (("kyc", "KYC"),))) == [
        "KYC", "Unclassified", "App Speed"]


def test_fences(values):
    assert values(["```json\n[1]\n```", "[2]"], text.strip_fences) == ["[1]", "[2]"]


def test_weeks(values):
    cases = {"2026-W35": D(2026, 8, 29), "2026-w01": D(2026, 1, 3), "2020-W53": D(2021, 1, 2), "2021-W53": None,
             "2026-08-30T10": D(2026, 8, 30), "20260830": D(2026, 8, 30), "soon": None, "": None}
    assert values(list(cases), dates.parse_week) == list(cases.values())
    days = [D(2021, 1, 2), D(2026, 8, 30), D(2024, 12, 30)]
    assert values(days, dates.iso_week_label, "date") == ["2020-W53", "2026-W35", "2025-W01"]


def test_range_labels(values):
    days = [D(2026, 9, 20), D(2026, 9, 2), D(2026, 1, 3)]
    got = values(days, lambda c: dates.range_label(dates.reporting_from(c), c), "date")
    assert got == ["Sep 14 – 20, 2026", "Aug 27 – Sep 2, 2026", "Dec 28, 2025 – Jan 3, 2026"]


def test_weeks_behind_across_years(values):
    assert values([D(2025, 12, 27), D(2026, 1, 20)], lambda c: dates.weeks_behind(c, F.lit(D(2026, 1, 10))), "date") == [2, 0]
