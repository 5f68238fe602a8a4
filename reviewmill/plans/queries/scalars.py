"""Queries over single expressions: dates, ratings, labels, text blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.functions import dates, render, text
from reviewmill.plans.queries.inputs import BLANK_SQL, table
from reviewmill.plans.queries.registry import query


@query("""
SELECT event_id, CASE event_id % 12 WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE CAST(ts AS DATE) END AS day
FROM events""")
def lenient_dates(spark, sf_dir):
    """Event times written in twelve forms, the last three of them unusable."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_id % 12
             WHEN 0 THEN date_format(ts, 'yyyy-MM-dd')
             WHEN 1 THEN concat(' ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '.250 ')
             WHEN 2 THEN date_format(ts, 'yyyy-M-d H:m:s')
             WHEN 3 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
             WHEN 4 THEN date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
             WHEN 5 THEN date_format(ts, 'M/d/yyyy')
             WHEN 6 THEN CASE WHEN day(ts) > 12 THEN date_format(ts, 'd/M/yyyy') ELSE date_format(ts, 'MM/dd/yyyy') END
             WHEN 7 THEN date_format(ts, 'yyyy/MM/dd')
             WHEN 8 THEN upper(date_format(ts, 'MMM d, yyyy'))
             WHEN 9 THEN date_format(ts, 'yyyy-MM-dd HH:mm')
             WHEN 10 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING)
             ELSE concat('2024-02-3', event_id % 2) END AS written""",
    )
    return rows.select("event_id", dates.parse_review_date(F.col("written")).alias("day"))


@query(r"""
SELECT event_id, CASE WHEN event_id % 7 IN (4, 5) THEN NULL WHEN value >= 1 AND value < 6 THEN CAST(floor(value) AS BIGINT) END AS rating
FROM events""")
def lenient_ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_id % 7 WHEN 4 THEN concat(value, 'd') WHEN 5 THEN 'nan' WHEN 6 THEN concat('+', value, 'e0')
             WHEN 3 THEN concat(' ', value, ' ') ELSE CAST(value AS STRING) END AS written""",
    )
    return rows.select("event_id", text.parse_rating(F.col("written")).alias("rating"))


@query("""
SELECT o_orderkey, CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS iso_week,
       CAST(date_trunc('week', o_orderdate) AS DATE) + 5 AS saturday,
       CASE WHEN year(o_orderdate - 6) <> year(o_orderdate) THEN strftime(o_orderdate - 6, '%b %-d, %Y – ') || strftime(o_orderdate, '%b %-d, %Y')
            WHEN month(o_orderdate - 6) <> month(o_orderdate) THEN strftime(o_orderdate - 6, '%b %-d – ') || strftime(o_orderdate, '%b %-d, %Y')
            ELSE strftime(o_orderdate - 6, '%b %-d – ') || strftime(o_orderdate, '%-d, %Y') END AS label
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders)""")
def week_labels(spark, sf_dir):
    """ISO week, its Saturday (by parsing the label back) and range label over years of dates."""
    day = F.col("o_orderdate").cast("date")
    label = dates.iso_week_label(day)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        label.alias("iso_week"),
        dates.parse_week(F.concat(F.lit(" "), F.lower(label))).alias("saturday"),
        dates.range_label(dates.reporting_from(day), day).alias("label"),
    )


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'Payments' WHEN 'click' THEN 'KYC' WHEN 'error' THEN 'Errors' WHEN 'signup' THEN 'Sign' ELSE 'purchase' END AS tag
FROM events""")
def short_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'view' THEN 'Payments' WHEN 'click' THEN 'kyc' ELSE event_type END AS theme_id",
        "CASE event_type WHEN 'error' THEN 'Errors & crashes' WHEN 'signup' THEN 'Sign / up' END AS label",
    )
    return rows.select("event_id", render.short_tag(F.col("theme_id"), F.col("label")).alias("tag"))


@query(f"""
SELECT doc_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '# Weekly Review Report of ' ELSE
         '# Log ' || CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS VARCHAR) || chr(10) || chr(10) END || body || chr(10) AS block
FROM (SELECT doc_id, rtrim(text, {BLANK_SQL}) AS body FROM documents)""")
def append_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        "CASE WHEN doc_id % 2 = 0 THEN concat('# Weekly Review Report of ', text, ' ') ELSE text END AS md",
        "date_add(DATE '2024-01-01', CAST(doc_id % 60 AS INT)) AS week",
        "doc_id",
    )
    return rows.select("doc_id", render.append_block(F.col("md"), F.col("week"), "Log {week_ending}").alias("block"))
