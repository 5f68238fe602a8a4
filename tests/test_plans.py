"""Plans keep the properties large inputs depend on."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from reviewmill.operators.ordering import corpus_position
from reviewmill.operators.quotes import rank_quotes
from reviewmill.operators.redaction import redact_reviews
from reviewmill.plans.ingest import ingest_reviews
from reviewmill.plans.queries.inputs import document_rows
from reviewmill.scale import stored

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["theme_statistics", "weekly_backfill", "reporting_windows", "corpus_order", "dedup_reviews", "period_slots"]
)
def test_no_pairing_of_all_rows(spark, name):
    text = plan(entry_point.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_statistics_read_few_columns_and_aggregate_before_the_shuffle(spark):
    text = plan(entry_point.queries()["theme_daily_rollup"](spark, DATA))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("props" not in s and "value" not in s for s in schemas)
    assert "partial_count" in text


def test_positions_deal_plain_ids_evenly(spark):
    """One product, one day, ids with a common prefix: rows still spread over the tasks."""
    rows = spark.range(4000).selectExpr(
        "'p' AS product_id", "DATE '2026-01-01' AS date", "concat('review-', lpad(CAST(id AS STRING), 6, '0')) AS id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = corpus_position(rows.repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    text = plan(placed)
    assert "Window" not in re.sub(r"(?s)BroadcastExchange.*", "", text) and "Scan ExistingRDD" in text
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    assert placed.where("id <> concat('review-', lpad(CAST(pos AS STRING), 6, '0'))").count() == 0


def test_candidate_limit_applies_before_the_shuffle(spark):
    source = spark.range(1000).selectExpr(
        "string(id % 3) AS product_id", "date_add(current_date(), int(id % 2)) AS week_ending", "string(id % 5) AS theme_id",
        "string(id) AS id", "double(id) AS distance",
    )
    assert "WindowGroupLimit" in plan(rank_quotes(source, 257))


def test_redaction_needs_no_shuffle_and_no_python(spark):
    rows = spark.range(5).selectExpr("string(id) AS text")
    text = plan(redact_reviews(rows, ["text"]))
    assert "Exchange" not in text and "Python" not in text


def test_ingest_reads_raw_rows_once(spark, tmp_path):
    """Everything comes from the staged table; counters read three narrow columns of it."""
    document_rows(spark, DATA).write.parquet(str(tmp_path / "raw_rows"))
    runs = []

    def stage(rows):
        runs.append(plan(rows))
        return stored(rows)

    out = ingest_reviews(spark.read.parquet(str(tmp_path / "raw_rows")), stage=stage)
    assert len(runs) == 1 and len(re.findall("raw_rows", runs[0])) == 1
    for df in (out.report, out.reviews, out.windows):
        assert "raw_rows" not in plan(df)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(out.report))
    assert schemas and not any("text" in s or "title" in s for s in schemas)
