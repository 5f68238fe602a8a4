"""Incremental ingest: new export rows are cleaned, redacted and appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewmill.config import DEFAULT, Config
from reviewmill.operators.clean import project_reviews
from reviewmill.operators.redaction import redact_reviews
from reviewmill.schemas import RAW_REVIEW


def read_landing(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw review rows landing as JSON lines."""
    return spark.readStream.schema(RAW_REVIEW).option("maxFilesPerTrigger", files_per_batch).json(folder)


def clean_stream(raw: DataFrame, cfg: Config = DEFAULT, remember: str = "35 days") -> DataFrame:
    """Usable, redacted reviews, each id once.

    The watermark runs on arrival time, so a review is never late because of its date. Ids are
    remembered for ``remember``; a copy that arrives later still shares its id and is removed
    by the de-duplication of the batch job.
    """
    usable = project_reviews(raw, cfg.limits.min_review_words).filter(F.col("drop_reason").isNull())
    arrived = usable.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", remember)
    unique = arrived.dropDuplicatesWithinWatermark(["product_id", "id"])
    return redact_reviews(unique.drop("drop_reason")).drop("redactions", "redacted")


def stream_ingest(
    spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: Config = DEFAULT, once: bool = True
) -> StreamingQuery:
    """Append new reviews to ``out``, partitioned by the Monday of their week; exactly once."""
    reviews = clean_stream(read_landing(spark, folder), cfg)
    writer = (
        reviews.withColumn("week_start", F.trunc("date", "week"))
        .writeStream.format("parquet")
        .partitionBy("week_start")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def weekly_counts(reviews: DataFrame, lateness: str = "28 days") -> DataFrame:
    """Running review counts per product and calendar week of a review stream."""
    day = reviews.withColumn("day", F.col("date").cast("timestamp")).withWatermark("day", lateness)
    week = F.window("day", "7 days", "7 days", "4 days")
    return day.groupBy("product_id", week).agg(
        F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.sum("rating").alias("rating_sum")
    )
