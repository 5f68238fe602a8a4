"""Tables a run writes: reviews, reports, themes, the archive, validation and the run log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from reviewmill.functions.dates import parse_week
from reviewmill.operators.periods import latest_reports
from reviewmill.scale import cut_lineage
from reviewmill.schemas import REPORT, REVIEW

ARCHIVE_KEY = ["product_id", "week_ending"]
# Folders of a day; products are dealt to them by a hash.
PRODUCT_BUCKETS = 16
_REVIEW_COLUMNS = [part.split()[0] for part in REVIEW.split(", ")]

# Header of the CSV export, and the raw column behind each name.
EXPORT_COLUMNS = {
    "Review Submit Date and Time": "date_raw",
    "Star Rating": "rating_raw",
    "Review Title": "title",
    "Review Text": "text",
    "App Version Name": "app_version",
}


def write_reviews(reviews: DataFrame, path: str) -> None:
    """Only the review columns leave a stage, in a folder for each day and bucket of products.

    A product's rows of the days written are replaced; its other days and all other products stay. Only
    folders that get new rows are read and rewritten. Readers that bound ``date`` read only the days
    between. The reviews are read twice: for the days and products they touch, and to be written.
    """
    bucket = F.pmod(F.xxhash64("product_id"), F.lit(PRODUCT_BUCKETS)).cast("int").alias("bucket")
    new = reviews.select(*_REVIEW_COLUMNS, bucket)
    # A struct also joins where the product is null.
    product = F.struct("product_id").alias("_product")
    touched = cut_lineage(new.select("date", "bucket", product).distinct())
    bounds = touched.agg(F.min("date"), F.max("date"), F.sort_array(F.collect_set("bucket"))).first()
    kept = _stored_reviews(reviews.sparkSession, path)
    if kept is not None and bounds[0] is not None:
        held = kept.filter(F.col("date").between(F.lit(bounds[0]), F.lit(bounds[1])) & F.col("bucket").isin(bounds[2]))
        held = held.join(touched.select("date", "bucket").distinct(), ["date", "bucket"], "left_semi")
        others = held.select("*", product).join(touched, ["date", "bucket", "_product"], "left_anti")
        # They come from the folders about to be replaced, so they are stored first.
        new = new.unionByName(cut_lineage(others.select(*new.columns)))
    (
        new.hint("rebalance", "date", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "bucket")
        .parquet(path)
    )


def _stored_reviews(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{REVIEW}, bucket int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """A stage report: one row per product."""
    report.write.mode("overwrite").json(path)


def write_export_csv(raw: DataFrame, path: str) -> None:
    """The five-column CSV export."""
    raw.select(*(F.col(c).alias(name) for name, c in EXPORT_COLUMNS.items())).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)


def append_validation(validation: DataFrame, path: str) -> None:
    validation.write.mode("append").parquet(path)


def append_run_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def load_archive(spark: SparkSession, path: str) -> DataFrame:
    """The report archive, partitioned by week; empty where none was written yet.

    Folders that are not named after a date are ignored.
    """
    schema = f"{REPORT}, md string"
    try:
        return spark.read.schema(schema).parquet(path).filter(F.col("week_ending").isNotNull())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def archive_reports(reports: DataFrame, path: str) -> None:
    """Insert or replace reports by product and week.

    Only the touched week partitions are read and rewritten, with the other products' reports in them.
    A report without a week is an error.
    """
    spark = reports.sparkSession
    if not reports.filter(F.col("week_ending").isNull()).isEmpty():
        raise ValueError("report without week_ending")
    new = cut_lineage(reports.select(*load_archive(spark, path).columns))
    weeks = [r["week_ending"] for r in new.select("week_ending").distinct().collect()]
    others = (
        load_archive(spark, path)
        .filter(F.col("week_ending").isin(weeks))
        .join(new.select(*ARCHIVE_KEY), ARCHIVE_KEY, "left_anti")
    )
    # The rows to keep come from the partitions about to be replaced, so store them first.
    merged = cut_lineage(others.unionByName(new))
    # Rebalancing gathers a week into few files but splits a large one over several tasks.
    (
        merged.hint("rebalance", "week_ending")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("week_ending")
        .parquet(path)
    )


def load_report(spark: SparkSession, path: str, week: str | dt.date | None = None) -> DataFrame:
    """Reports of one week (a date or ``YYYY-Www``), or the newest per product."""
    archive = load_archive(spark, path)
    if week is None:
        return latest_reports(archive)
    day = spark.range(1).select(parse_week(F.lit(str(week))).alias("d")).first()["d"]
    return archive.filter(F.col("week_ending") == F.lit(day).cast("date"))


def save_registry(registry: DataFrame, path: str) -> None:
    """Replace the small registry table; its rows are stored first as they may come from it."""
    cut_lineage(registry).hint("rebalance").write.mode("overwrite").parquet(path)
