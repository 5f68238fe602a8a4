"""Rows handed to a text model, and its replies read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT
from reviewmill.functions.text import strip_fences, truncate
from reviewmill.operators.ordering import corpus_position
from reviewmill.schemas import ASSIGNMENT_REPLY

_WITH_NULLS = {"ignoreNullFields": "false"}


def number_batches(reviews: DataFrame, batch_size: int = DEFAULT.limits.batch_size) -> DataFrame:
    """Add ``pos`` and ``batch_no``: runs of ``batch_size`` reviews in corpus order per product."""
    placed = corpus_position(reviews)
    return placed.withColumn("batch_no", F.floor(F.col("pos") / batch_size).cast("bigint"))


def batch_payloads(
    reviews: DataFrame,
    batch_size: int = DEFAULT.limits.batch_size,
    max_chars: int = DEFAULT.limits.payload_chars,
) -> DataFrame:
    """One compact JSON array per batch: review id, shortened text, rating."""
    row = F.struct(
        "pos", F.col("id").alias("review_id"), truncate(F.col("text"), max_chars).alias("text"), "rating"
    )
    packed = number_batches(reviews, batch_size).groupBy("product_id", "batch_no").agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    items = F.transform("rows", lambda r: F.struct(r["review_id"], r["text"], r["rating"]))
    return packed.select("product_id", "batch_no", F.to_json(items, _WITH_NULLS).alias("payload"))


def theme_payload(top: DataFrame) -> DataFrame:
    """The top themes of each report as one JSON array."""
    row = F.struct("rank", "theme_id", "label", "count_week", "avg_rating_week", "trend")
    packed = top.groupBy("product_id", "week_ending").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    items = F.transform(
        "rows",
        lambda r: F.struct(r["theme_id"], r["label"], r["count_week"], r["avg_rating_week"], r["trend"]),
    )
    return packed.select("product_id", "week_ending", F.to_json(items, _WITH_NULLS).alias("themes_json"))


def quote_payload(pool: DataFrame) -> DataFrame:
    """The candidate quotes of each report as one JSON object keyed by theme."""
    row = F.struct("rank", F.col("id").alias("review_id"), "text", "rating")
    per_theme = pool.groupBy("product_id", "week_ending", "theme_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    items = F.transform("rows", lambda r: F.struct(r["review_id"], r["text"], r["rating"]))
    entry = F.struct("theme_id", items.alias("quotes"))
    return per_theme.groupBy("product_id", "week_ending").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))), _WITH_NULLS).alias("quotes_json")
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """Assignments from reply texts in (product_id, batch_no, reply).

    A reply is a JSON list or ``{"assignments": [...]}``, possibly fenced. A reply with any
    unusable entry counts as failed and yields no rows, so its reviews end up in ``other``.
    """
    body = strip_fences(F.col("reply"))
    wrapped = F.when(body.startswith("["), F.concat(F.lit('{"assignments":'), body, F.lit("}"))).otherwise(body)
    parsed = F.from_json(wrapped, f"struct<assignments:{ASSIGNMENT_REPLY}>")["assignments"]
    sound = F.forall(
        "items",
        lambda a: F.coalesce(
            a["review_id"].isNotNull() & a["theme_id"].isNotNull() & a["confidence"].between(0.0, 1.0),
            F.lit(False),
        ),
    )
    return (
        replies.withColumn("items", parsed)
        .filter(sound)
        .select("product_id", "batch_no", F.posexplode("items").alias("pos", "a"))
        .select("product_id", "a.review_id", "a.theme_id", "a.confidence", "batch_no", "pos")
    )
