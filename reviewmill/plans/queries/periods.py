"""Queries over the report archive: newest, slots, lookups, registry, write-backs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reviewmill.functions import dates, render
from reviewmill.functions.numbers import ratio_2dp
from reviewmill.operators import periods
from reviewmill.operators.windows import daily_rollup
from reviewmill.plans.queries.inputs import EV, event_reviews, mean_sql
from reviewmill.plans.queries.registry import query
from reviewmill.scale import cut_lineage

_TODAY = dt.date(2024, 2, 15)

# The archive holds the calendar weeks, by their Saturday, in which a product had 15 reviews or more.
ARCHIVE = EV + f""",
ev_weekly AS (
  SELECT product_id, CAST(date_trunc('week', date) AS DATE) + 5 AS week_ending, count(*) AS n,
         {mean_sql('sum(rating)', 'count(rating)')} AS avg_rating_week
  FROM ev GROUP BY product_id, CAST(date_trunc('week', date) AS DATE)),
archive AS (
  SELECT *, CASE WHEN n % 2 = 0 THEN 'doc-' || product_id END AS doc_url, CAST(NULL AS VARCHAR) AS draft_id FROM ev_weekly WHERE n >= 15),
registry AS (
  SELECT product_id, CAST(week_ending AS VARCHAR) AS week_ending, CASE WHEN n % 3 = 0 THEN 'doc-' || CAST(n AS VARCHAR) ELSE '' END AS document_id
  FROM archive WHERE n % 2 = 1
  UNION ALL SELECT DISTINCT product_id, '_default', 'main-' || product_id FROM archive)"""

SLOTS = ARCHIVE + """,
products AS (SELECT DISTINCT product_id FROM ev),
newest AS (
  SELECT p.product_id, coalesce(max(a.week_ending), DATE '2024-02-10') AS anchor, least(count(a.week_ending), 4) AS have
  FROM products p LEFT JOIN archive a USING (product_id) GROUP BY p.product_id),
taken AS (
  SELECT product_id, week_ending, row_number() OVER (PARTITION BY product_id ORDER BY week_ending DESC) AS slot FROM archive),
free AS (
  SELECT product_id, have, anchor - 7 * k AS week_ending FROM newest, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k)
  WHERE have < 4 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.product_id = newest.product_id AND t.slot <= 4 AND t.week_ending = anchor - 7 * k)),
slots AS (
  SELECT product_id, slot, week_ending, true AS available FROM taken WHERE slot <= 4
  UNION ALL
  SELECT product_id, slot, week_ending, false FROM (
    SELECT product_id, week_ending, have + row_number() OVER (PARTITION BY product_id ORDER BY week_ending DESC) AS slot FROM free) WHERE slot <= 4)"""

_LABEL = """CASE WHEN month(week_ending - 6) <> month(week_ending) AND year(week_ending - 6) <> year(week_ending)
            THEN strftime(week_ending - 6, '%b %-d, %Y – ') || strftime(week_ending, '%b %-d, %Y')
          WHEN month(week_ending - 6) <> month(week_ending) THEN strftime(week_ending - 6, '%b %-d – ') || strftime(week_ending, '%b %-d, %Y')
          ELSE strftime(week_ending - 6, '%b %-d – ') || strftime(week_ending, '%-d, %Y') END"""
_ISO = "CAST(isoyear(week_ending) AS VARCHAR) || '-W' || lpad(CAST(week(week_ending) AS VARCHAR), 2, '0')"


def weekly_counts(spark, sf_dir):
    """One row per product and week, stored: the archive, registry and slots all derive from it."""
    daily = daily_rollup(event_reviews(spark, sf_dir))
    week = F.date_add(F.trunc("date", "week"), 5).alias("week_ending")
    return cut_lineage(
        daily.groupBy("product_id", week).agg(
            F.sum("n").alias("n"), ratio_2dp(F.sum("rating_sum"), F.sum("rated")).alias("avg_rating_week")
        )
    )


def archive(spark, sf_dir):
    return archive_of(weekly_counts(spark, sf_dir))


def archive_of(weekly):
    return weekly.filter("n >= 15").selectExpr(
        "product_id",
        "week_ending",
        "n",
        "avg_rating_week",
        "CASE WHEN n % 2 = 0 THEN concat('doc-', product_id) END AS doc_url",
        "CAST(NULL AS STRING) AS draft_id",
    )


def registry(reports):
    own = reports.filter("n % 2 = 1").selectExpr(
        "product_id",
        "CAST(week_ending AS STRING) AS week_ending",
        "CASE WHEN n % 3 = 0 THEN concat('doc-', n) ELSE '' END AS document_id",
    )
    default = reports.select("product_id").distinct().selectExpr(
        "product_id", "'_default' AS week_ending", "concat('main-', product_id) AS document_id"
    )
    return own.unionByName(default)


def slots(weekly):
    return periods.period_weeks(archive_of(weekly), products=weekly, today=_TODAY)


@query(f"WITH {ARCHIVE} SELECT product_id, week_ending, n, avg_rating_week FROM archive QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY week_ending DESC) = 1")
def latest_reports(spark, sf_dir):
    return periods.latest_reports(archive(spark, sf_dir)).select("product_id", "week_ending", "n", "avg_rating_week")


@query(f"WITH {ARCHIVE} SELECT product_id, week_ending, n FROM archive WHERE week_ending = DATE '2024-01-20'")
def report_of_week(spark, sf_dir):
    return periods.report_of_week(archive(spark, sf_dir), "2024-W03").select("product_id", "week_ending", "n")


@query(f"""WITH {ARCHIVE}, newest AS (SELECT product_id, max(week_ending) AS week_ending FROM ev_weekly GROUP BY product_id)
SELECT n.product_id, n.week_ending FROM newest n LEFT JOIN archive a USING (product_id, week_ending) WHERE a.n IS NULL""")
def history_backfill(spark, sf_dir):
    weekly = weekly_counts(spark, sf_dir)
    latest = periods.latest_reports(weekly)
    return periods.missing_from_history(latest, archive_of(weekly)).select("product_id", "week_ending")


@query(f"""WITH {SLOTS}
SELECT product_id, slot, week_ending, {_ISO} AS iso_week, week_ending - 6 AS "from", week_ending AS "to", {_LABEL} AS label,
       available, slot = 1 AS is_latest FROM slots""")
def period_slots(spark, sf_dir):
    return slots(weekly_counts(spark, sf_dir))


@query(f"""WITH {SLOTS}, asked AS (
  SELECT DISTINCT product_id, ' ' || lower({_ISO}) || ' ' AS query FROM ev_weekly
  UNION ALL SELECT DISTINCT product_id, '2024-01-13T00:00' FROM ev_weekly
  UNION ALL SELECT DISTINCT product_id, 'last week' FROM ev_weekly),
parsed AS (
  SELECT *, CASE WHEN query LIKE '2024-01-13%' THEN DATE '2024-01-13'
                 WHEN query LIKE ' 2024-w%' THEN DATE '2024-01-06' + 7 * (CAST(substr(trim(query), 7) AS INT) - 1) END AS day FROM asked)
SELECT product_id, query, coalesce((SELECT min(s.week_ending) FROM slots s WHERE s.product_id = parsed.product_id AND (s.week_ending = parsed.day
         OR CAST(isoyear(s.week_ending) AS VARCHAR) || '-W' || lpad(CAST(week(s.week_ending) AS VARCHAR), 2, '0') = upper(trim(query)))), day) AS resolved
FROM parsed""")
def resolved_weeks(spark, sf_dir):
    weekly = weekly_counts(spark, sf_dir)
    label = F.concat(F.lit(" "), F.lower(dates.iso_week_label(F.col("week_ending"))), F.lit(" "))
    asked = (
        weekly.select("product_id", label.alias("query"))
        .unionByName(weekly.select("product_id", F.lit("2024-01-13T00:00").alias("query")).distinct())
        .unionByName(weekly.select("product_id", F.lit("last week").alias("query")).distinct())
    )
    return periods.resolve_weeks(asked, slots(weekly))


@query(f"""WITH {ARCHIVE}
SELECT product_id, week_ending, CASE WHEN n % 5 = 0 THEN 'new-' || CAST(n AS VARCHAR) ELSE doc_url END AS doc_url,
       CASE WHEN n % 5 <= 1 THEN 'draft-' || CAST(n AS VARCHAR) ELSE draft_id END AS draft_id FROM archive""")
def publish_ids(spark, sf_dir):
    reports = archive(spark, sf_dir)
    published = reports.filter("n % 5 <= 1").selectExpr(
        "product_id",
        "week_ending",
        "CASE WHEN n % 5 = 0 THEN concat('new-', n) END AS doc_url",
        "concat('draft-', n) AS draft_id",
    )
    return periods.publish_ids(reports, published).select("product_id", "week_ending", "doc_url", "draft_id")


@query(f"""WITH {ARCHIVE}, new AS (
  SELECT product_id, CAST(week_ending AS VARCHAR) AS week_ending, 'pub-' || CAST(n AS VARCHAR) AS document_id FROM archive WHERE n % 4 = 1
  UNION ALL SELECT DISTINCT product_id, '_default', 'configured' FROM archive WHERE n % 4 = 1)
SELECT * FROM new UNION ALL
SELECT r.* FROM registry r WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.product_id = r.product_id AND n.week_ending = r.week_ending)""")
def registry_upsert(spark, sf_dir):
    reports = archive(spark, sf_dir)
    published = reports.filter("n % 4 = 1").selectExpr(
        "product_id", "week_ending", "concat('pub-', n) AS document_id"
    )
    return periods.registry_upsert(registry(reports), published, "configured")


@query(f"""WITH {ARCHIVE}
SELECT a.product_id, a.week_ending, coalesce(nullif(r.document_id, ''), nullif(d.document_id, '')) AS document_id
FROM ev_weekly a LEFT JOIN registry r ON r.product_id = a.product_id AND r.week_ending = CAST(a.week_ending AS VARCHAR)
LEFT JOIN registry d ON d.product_id = a.product_id AND d.week_ending = '_default'""")
def registry_resolution(spark, sf_dir):
    weekly = weekly_counts(spark, sf_dir)
    return periods.resolve_document(weekly.select("product_id", "week_ending"), registry(archive_of(weekly)))


@query(f"WITH {ARCHIVE} SELECT product_id, week_ending FROM archive WHERE n % 2 = 0")
def pending_weeks(spark, sf_dir):
    reports = archive(spark, sf_dir)
    return periods.pending_weeks(reports, registry(reports)).select("product_id", "week_ending")


@query(f"""WITH {ARCHIVE}
SELECT product_id, week_ending, {_ISO} AS iso_week, (max(week_ending) OVER (PARTITION BY product_id) - week_ending) // 7 AS weeks_behind,
       CASE WHEN avg_rating_week IS NULL THEN 'n/a' WHEN round(avg_rating_week * 100) % 50 = 25 THEN
         CAST(floor(avg_rating_week * 10) / 10 + 0.1 AS DECIMAL(3, 1)) :: VARCHAR ELSE printf('%.1f', avg_rating_week) END AS stars,
       coalesce(avg_rating_week < 2.5, false) AS low, '/?week=' || {_ISO} AS share FROM archive""")
def report_display(spark, sf_dir):
    reports = periods.add_weeks_behind(archive(spark, sf_dir))
    return reports.select(
        "product_id",
        "week_ending",
        dates.iso_week_label(F.col("week_ending")).alias("iso_week"),
        "weeks_behind",
        render.rating_text(F.col("avg_rating_week")).alias("stars"),
        render.is_low(F.col("avg_rating_week")).alias("low"),
        render.share_path(F.col("week_ending")).alias("share"),
    )
