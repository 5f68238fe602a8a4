import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.functions import language, text
from reviewmill.operators import clean
from reviewmill.operators.language import detect, learn_profile, profile_table, read_profile

DATA = "/root/testdata/sf0.01"
SAMPLES = {
    "en": "the app keeps closing when i open my orders and the support team never answers the mails",
    "de": "die app schließt sich immer wenn ich meine bestellungen öffne und der kundendienst antwortet nicht",
    "fr": "l'application se ferme quand j'ouvre mes commandes et le service client ne répond jamais aux messages",
    "es": "la aplicación se cierra cuando abro mis pedidos y el servicio al cliente nunca responde a los mensajes",
}


@pytest.fixture(scope="module")
def profile(spark):
    random_ = random.Random(1)
    rows = []
    for lang, sample in SAMPLES.items():
        words = sample.split()
        rows += [(" ".join(random_.choices(words, k=12)), lang) for _ in range(40)]
    return learn_profile(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_equal_plain_python(spark):
    rows = [("Ab, ab! é", "x"), ("ABC 12", "y"), (None, "x"), ("no", None), ("...", "y"), ("", "y")]
    got = learn_profile(spark.createDataFrame(rows, "text string, lang string"))
    assert got.languages == ("x", "y")
    for lang, body in (("x", " ab ab é "), ("y", " abc ")):
        counts = np.zeros(language.BUCKETS)
        for a, b, c in zip(body, body[1:], body[2:]):
            counts[((ord(a) * 31 + ord(b)) * 31 + ord(c)) % language.BUCKETS] += 1
        want = np.floor(np.log((counts + 1) / (counts.sum() + language.BUCKETS)) * 1000)
        assert (got.weights[got.languages.index(lang)] == want).all()


def test_short_texts_of_each_language(values, profile):
    short = {
        "en": "the support never answers",
        "de": "der kundendienst antwortet nicht",
        "fr": "le service ne répond jamais",
        "es": "el servicio nunca responde",
    }
    got = values(list(short.values()), language.guess(profile))
    assert [r.lang for r in got] == list(short) and all(r.prob >= 0.5 and r.margin > 0 for r in got)


def test_texts_without_letters_empty_and_very_long(values, profile, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 50)
    items = [None, "", "123 !", "a", SAMPLES["de"] * 2000, SAMPLES["en"]]
    got = values(items, language.guess(profile))
    assert got[:3] == [None, None, None] and got[3].trigrams == 1
    assert (got[4].lang, got[5].lang) == ("de", "en")


def test_profile_as_a_table(spark, profile):
    again = read_profile(profile_table(spark, profile))
    assert again.languages == profile.languages and (again.weights == profile.weights).all()


def test_no_languages_and_too_many(spark, values):
    none = learn_profile(spark.createDataFrame([("abc", None)], "text string, lang string"))
    assert none.languages == () and values(["abc"], language.guess(none)) == [None]
    with pytest.raises(ValueError, match="languages"):
        learn_profile(spark.range(300).selectExpr("'abc' AS text", "CAST(id AS STRING) AS lang"))


def test_english_kept_and_others_dropped(spark, profile):
    """Plain Latin letters are no longer enough; texts without letters are left to the letters' rule."""
    plain = {k: v.replace("ß", "ss").replace("ö", "oe").replace("é", "e").replace("ó", "o") for k, v in SAMPLES.items()}
    rows = [(k, "2026-08-30", "5", "t", v, "1", "f", i) for i, (k, v) in enumerate(plain.items())]
    columns = "product_id string, date_raw string, rating_raw string, title string, text string, app_version string, source_file string, row_no int"
    raw = spark.createDataFrame(rows, columns)
    got = {r.product_id: r.drop_reason for r in clean.project_reviews(raw, detector=language.guess(profile)).collect()}
    assert got == {"en": None, "de": "non_english", "fr": "non_english", "es": "non_english"}
    assert {r.drop_reason for r in clean.project_reviews(raw).collect()} == {None}


def test_other_scripts_stay_foreign(values, profile):
    items = ["the support team never answers हिन्दी पाठ", "the support team never answers", "ok"]
    assert values(items, lambda c: text.is_english(c, language.guess(profile))) == [False, True, False]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = detect(docs.where(held), learn_profile(docs.where(~held)))
    right, known = found.agg(F.count_if(F.col("guess.lang") == F.col("lang")), F.count("guess")).first()
    assert known > 150 and right >= 0.97 * known
