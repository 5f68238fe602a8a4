"""Import from database tables, and read back tables an earlier run wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from reviewmill.operators.clean import import_rows
from reviewmill.schemas import REGISTRY, REVIEW

# Columns that mark a table as holding reviews.
REVIEW_LIKE = ("content", "text", "review", "body", "review_text")


def find_review_table(spark: SparkSession, database: str) -> str | None:
    """The first table of a catalog database that has a review-like column."""
    for table in spark.catalog.listTables(database):
        name = table.name if table.isTemporary else f"{database}.{table.name}"
        if any(c.name.lower() in REVIEW_LIKE for c in spark.catalog.listColumns(name)):
            return name
    return None


def read_jdbc(spark: SparkSession, url: str, table: str, partition: dict | None = None, **options) -> DataFrame:
    """A database table. ``partition`` takes column, lower, upper and parts for a parallel read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        reader = reader.options(
            partitionColumn=partition["column"],
            lowerBound=str(partition["lower"]),
            upperBound=str(partition["upper"]),
            numPartitions=str(partition["parts"]),
        )
    return reader.load()


def import_table(table: DataFrame, product_id: Column, name: str, row_no: Column | None = None) -> DataFrame:
    """Raw reviews of a review-like table; see ``import_rows``."""
    return import_rows(table, product_id, name, F.monotonically_increasing_id() if row_no is None else row_no)


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Normalized or redacted reviews written by an earlier stage."""
    columns = [part.split()[0] for part in REVIEW.split(", ")]
    return spark.read.schema(REVIEW).parquet(path).select(*columns)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The publish registry; a missing one is empty."""
    schema = f"product_id string, {REGISTRY}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
