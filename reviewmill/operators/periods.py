"""Archive queries: latest report, period slots, week lookup, registry and pending weeks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions import dates
from reviewmill.functions.text import strip


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report per product. There is no second copy to keep in step."""
    newest = F.max_by(F.struct(*(c for c in reports.columns if c != "product_id")), "week_ending")
    return reports.groupBy("product_id").agg(newest.alias("_r")).select("product_id", "_r.*")


def report_of_week(reports: DataFrame, week: str | dt.date | None = None) -> DataFrame:
    """Reports of one week, given as a date or ``YYYY-Www``; without a week the newest ones."""
    if week is None:
        return latest_reports(reports)
    return reports.filter(F.col("week_ending") == dates.parse_week(F.lit(str(week))))


def missing_from_history(latest: DataFrame, history: DataFrame) -> DataFrame:
    """Latest reports the history does not hold yet."""
    return latest.join(history.select("product_id", "week_ending"), ["product_id", "week_ending"], "left_anti")


def last_saturday(today: dt.date) -> dt.date:
    return today - dt.timedelta(days=(today.weekday() + 2) % 7)


def period_weeks(
    reports: DataFrame,
    count: int = 4,
    reporting_days: int = 7,
    products: DataFrame | None = None,
    today: dt.date | None = None,
) -> DataFrame:
    """``count`` period slots per product: archived weeks, newest first, then weekly gap fillers.

    Fillers step back seven days from the newest archived week, or from the last Saturday where
    nothing is archived; they follow the archived slots.
    """
    saturday = F.lit(last_saturday(today or dt.date.today()))
    weeks = reports.select("product_id", "week_ending").distinct()
    newest_first = Window.partitionBy("product_id").orderBy(F.col("week_ending").desc())
    archived = (
        weeks.withColumn("slot", F.row_number().over(newest_first))
        .filter(F.col("slot") <= count)
        .withColumn("available", F.lit(True))
    )
    known = archived.groupBy("product_id").agg(
        F.max("week_ending").alias("anchor"), F.count(F.lit(1)).alias("have")
    )
    if products is not None:
        known = products.select("product_id").distinct().join(known, "product_id", "left")
    known = known.withColumns(
        {"anchor": F.coalesce(F.col("anchor"), saturday), "have": F.coalesce(F.col("have"), F.lit(0))}
    )
    back = F.sequence(
        F.col("anchor"), F.date_sub(F.col("anchor"), 7 * (2 * count - 1)), F.expr("interval -7 days")
    )
    fillers = (
        known.filter(F.col("have") < count)
        .select("product_id", "have", F.explode(back).alias("week_ending"))
        .join(archived.select("product_id", "week_ending"), ["product_id", "week_ending"], "left_anti")
        .withColumn("slot", F.col("have") + F.row_number().over(newest_first))
        .filter(F.col("slot") <= count)
        .select("product_id", "week_ending", "slot", F.lit(False).alias("available"))
    )
    start = dates.reporting_from(F.col("week_ending"), reporting_days)
    return (
        archived.select("product_id", "week_ending", "slot", "available")
        .unionByName(fillers)
        .select(
            "product_id",
            F.col("slot").cast("int").alias("slot"),
            "week_ending",
            dates.iso_week_label(F.col("week_ending")).alias("iso_week"),
            start.alias("from"),
            F.col("week_ending").alias("to"),
            dates.range_label(start, F.col("week_ending")).alias("label"),
            "available",
            (F.col("slot") == 1).alias("is_latest"),
        )
    )


def resolve_weeks(queries: DataFrame, slots: DataFrame) -> DataFrame:
    """``resolved`` date per (product_id, query): a matching slot first, else the parsed text."""
    row = F.struct("slot", "week_ending", "iso_week")
    listed = slots.groupBy("product_id").agg(F.array_sort(F.collect_list(row)).alias("_slots"))
    raw = strip(F.col("query"))
    hit = F.get(
        F.filter(
            "_slots",
            lambda s: (s["iso_week"] == F.upper(raw))
            | (s["week_ending"].cast("string") == F.substring(raw, 1, 10)),
        ),
        0,
    )["week_ending"]
    return queries.join(listed, "product_id", "left").withColumn(
        "resolved", F.coalesce(hit, dates.parse_week(F.col("query")))
    ).drop("_slots")


def publish_ids(reports: DataFrame, published: DataFrame) -> DataFrame:
    """Write document and draft ids back; a missing new id keeps the old one."""
    new = published.select(
        "product_id", "week_ending", F.col("doc_url").alias("_url"), F.col("draft_id").alias("_draft")
    )
    joined = reports.join(new, ["product_id", "week_ending"], "left")
    return joined.withColumns(
        {
            "doc_url": F.coalesce(F.col("_url"), F.col("doc_url")),
            "draft_id": F.coalesce(F.col("_draft"), F.col("draft_id")),
        }
    ).select(*reports.columns)


def registry_upsert(registry: DataFrame, published: DataFrame, configured_id: str | None = None) -> DataFrame:
    """Registry after a publish: new ids replace old ones per week, plus ``_default`` if configured."""
    new = published.select(
        "product_id", F.col("week_ending").cast("string").alias("week_ending"), "document_id"
    )
    if configured_id:
        new = new.unionByName(
            new.select("product_id").distinct().select(
                "product_id", F.lit("_default").alias("week_ending"), F.lit(configured_id).alias("document_id")
            )
        )
    kept = registry.join(new.select("product_id", "week_ending"), ["product_id", "week_ending"], "left_anti")
    return kept.unionByName(new)


def resolve_document(weeks: DataFrame, registry: DataFrame, configured_id: str | None = None) -> DataFrame:
    """Document per week: its registry entry, else the configured id, else the default entry."""
    key = F.col("week_ending").cast("string")
    by_week = registry.select("product_id", F.col("week_ending").alias("_key"), F.col("document_id").alias("_own"))
    default = registry.filter(F.col("week_ending") == "_default").select(
        "product_id", F.col("document_id").alias("_default")
    )
    joined = (
        weeks.withColumn("_key", key)
        .join(by_week, ["product_id", "_key"], "left")
        .join(default, "product_id", "left")
    )

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return joined.withColumn(
        "document_id",
        F.coalesce(
            given(F.col("_own")), given(F.lit(configured_id).cast("string")), given(F.col("_default"))
        ),
    ).select(*weeks.columns, "document_id")


def pending_weeks(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """Reports whose week is not in the registry yet."""
    done = registry.select("product_id", F.col("week_ending").alias("_key"))
    return (
        reports.withColumn("_key", F.col("week_ending").cast("string"))
        .join(done, ["product_id", "_key"], "left_anti")
        .drop("_key")
    )


def add_weeks_behind(reports: DataFrame) -> DataFrame:
    """Weeks each report lies behind the newest one of its product."""
    newest = Window.partitionBy("product_id")
    return reports.withColumn(
        "weeks_behind", dates.weeks_behind(F.col("week_ending"), F.max("week_ending").over(newest))
    )
