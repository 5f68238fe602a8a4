"""A language profile learnt from labelled texts, kept as a table, and texts' languages by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions import language

PROFILE = "lang string, bucket int, weight bigint"
MOST_LANGUAGES = 256


def learn_profile(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> language.Profile:
    """The profile of a table of texts and their languages; rows without either teach nothing.

    Tasks count trigram buckets by language, and at most buckets x languages sums reach the driver,
    whatever the number of texts. More than ``MOST_LANGUAGES`` languages are an error: such a column
    names something else.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), language.normalised(F.col(text_col)).alias("text")
    )
    rows = rows.where(F.col("text").isNotNull())
    found = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    place = {lang: i for i, lang in enumerate(sorted(found))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(place), language.BUCKETS), np.int64)
        for batch in batches:
            langs = np.array([place[v] for v in batch.column("lang").to_pylist()], np.int64)
            for start, texts in language.chunks(batch.column("text")):
                of, bucket = language.trigrams(texts)
                cells = np.bincount(langs[start + of] * language.BUCKETS + bucket, minlength=totals.size)
                totals += cells.reshape(totals.shape)
        lang, bucket = np.nonzero(totals)
        columns = [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(totals[lang, bucket])]
        yield pa.RecordBatch.from_arrays(columns, ["place", "bucket", "n"])

    sums = rows.mapInArrow(count, "place int, bucket int, n bigint").groupBy("place", "bucket").agg(F.sum("n").alias("n"))
    counts = {lang: np.zeros(language.BUCKETS, np.int64) for lang in place}
    names = sorted(place)
    got = sums.toPandas()
    for i, lang in enumerate(names):
        own = got[got["place"] == i]
        counts[lang][own["bucket"].to_numpy()] = own["n"].to_numpy()
    return language.profile_of(counts)


def profile_table(spark: SparkSession, profile: language.Profile) -> DataFrame:
    """The profile as rows, to be written once and read by every job."""
    return spark.createDataFrame(list(language.table_rows(profile)), PROFILE)


def read_profile(rows: DataFrame) -> language.Profile:
    got = rows.select("lang", "bucket", "weight").toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    weights = np.zeros((len(languages), language.BUCKETS), np.int64)
    for i, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        weights[i, own["bucket"].to_numpy()] = own["weight"].to_numpy()
    return language.Profile(languages, weights)


def detect(rows: DataFrame, profile: language.Profile, text_col: str = "text", into: str = "guess") -> DataFrame:
    """The rows with the guessed language of a text column."""
    return rows.withColumn(into, language.guess(profile)(F.col(text_col)))
