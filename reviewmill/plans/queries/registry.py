"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the equivalent SQL if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(spark, sf_dir))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so both engines agree on types."""
    whole = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *(F.col(f.name).cast("bigint") if isinstance(f.dataType, whole) else F.col(f.name) for f in df.schema.fields)
    )
