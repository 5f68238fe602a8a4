"""Queries over model payloads and replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from reviewmill.functions.text import truncate
from reviewmill.operators import payloads, themes
from reviewmill.plans.queries.inputs import BLANK_SQL, CONV, CONV_STATS, EV, conversation_reviews, event_reviews, table
from reviewmill.plans.queries.registry import query
from reviewmill.plans.queries.reports import conversation_pool
from reviewmill.plans.queries.themes import conversation_build


@query(f"""
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substr(t, 1, 119), {BLANK_SQL}) || '…' END AS text
FROM (SELECT doc_id, trim(text, {BLANK_SQL}) AS t FROM documents)""")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), 120).alias("text"))


@query(f"""WITH {EV} SELECT id, product_id, (row_number() OVER (PARTITION BY product_id ORDER BY date, id) - 1) // 10 AS batch_no FROM ev""")
def numbered_batches(spark, sf_dir):
    rows = event_reviews(spark, sf_dir).select("product_id", "date", "id")
    return payloads.number_batches(rows).select("id", "product_id", "batch_no")


@query(f"""WITH {CONV}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date, id) - 1 AS p FROM conv)
SELECT product_id, p // 10 AS batch_no, string_agg(id || '/' || CASE WHEN length(text) <= 120 THEN text
         ELSE rtrim(substr(text, 1, 119), {BLANK_SQL}) || '…' END || '/' || coalesce(CAST(rating AS VARCHAR), 'null'), ';' ORDER BY p) AS rows
FROM placed GROUP BY product_id, p // 10""")
def batch_payloads(spark, sf_dir):
    """Payload JSON per batch, read back to compare its content."""
    packed = payloads.batch_payloads(conversation_reviews(spark, sf_dir))
    items = F.from_json("payload", "array<struct<review_id:string,text:string,rating:int>>")
    row = lambda r: F.concat_ws(
        "/", r["review_id"], r["text"], F.coalesce(r["rating"].cast("string"), F.lit("null"))
    )
    return packed.select("product_id", "batch_no", F.array_join(F.transform(items, row), ";").alias("rows"))


@query(f"""WITH {CONV_STATS}
SELECT product_id, week_ending, string_agg(theme_id || '/' || label || '/' || CAST(count_week AS VARCHAR) || '/' ||
         coalesce(printf('%.2f', avg_rating_week), 'null') || '/' || trend, ';' ORDER BY rank) AS themes
FROM conv_top GROUP BY product_id, week_ending""")
def theme_payload(spark, sf_dir):
    """Theme JSON per report, read back to compare its content."""
    packed = payloads.theme_payload(conversation_build(spark, sf_dir)[2].top)
    kind = "array<struct<theme_id:string,label:string,count_week:bigint,avg_rating_week:double,trend:string>>"

    def line(t):
        avg = F.when(t["avg_rating_week"].isNotNull(), F.format_string("%.2f", t["avg_rating_week"])).otherwise("null")
        return F.concat_ws("/", t["theme_id"], t["label"], t["count_week"].cast("string"), avg, t["trend"])

    lines = F.transform(F.from_json("themes_json", kind), line)
    return packed.select("product_id", "week_ending", F.array_join(lines, ";").alias("themes"))


@query()
def quote_payload(spark, sf_dir):
    return payloads.quote_payload(conversation_pool(spark, sf_dir))


def _replies(spark, sf_dir):
    """Replies in the accepted spellings, and two unusable kinds, from the conversations."""
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "role AS product_id", "conv_id AS batch_no", "turn", "concat(conv_id, '-', turn) AS review_id"
    )
    entry = F.concat(
        F.lit('{"review_id":"'),
        F.col("review_id"),
        F.lit('","theme_id":"kyc","confidence":'),
        F.when(F.col("batch_no") % 5 == 4, F.lit("1.5")).otherwise(F.lit("0.25")),
        F.lit("}"),
    )
    packed = rows.groupBy("product_id", "batch_no").agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("items")
    )
    listed, enveloped = F.concat(F.lit("["), "items", F.lit("]")), F.concat(F.lit('{"assignments":['), "items", F.lit("]}"))
    kind = F.col("batch_no") % 5
    return packed.select(
        "product_id",
        "batch_no",
        F.when(kind == 0, listed)
        .when(kind == 1, enveloped)
        .when(kind == 2, F.concat(F.lit("```json\n"), enveloped, F.lit("\n```\n")))
        .when(kind == 3, F.concat(F.lit("Sure: "), listed))
        .otherwise(listed)
        .alias("reply"),
    )


@query("""
SELECT role AS product_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS review_id, 'kyc' AS theme_id,
       CAST(0.25 AS DOUBLE) AS confidence, conv_id AS batch_no
FROM conversations WHERE conv_id % 5 IN (0, 1, 2)""")
def parsed_replies(spark, sf_dir):
    """Lists, envelopes and fenced replies parse; chatter and impossible confidences do not."""
    return payloads.parse_replies(_replies(spark, sf_dir)).drop("pos")


@query(f"""WITH {CONV}, placed AS (
  SELECT *, (row_number() OVER (PARTITION BY product_id ORDER BY date, id) - 1) // 10 AS batch_no FROM conv),
longest AS (SELECT product_id, batch_no, max(length(text)) AS top FROM placed GROUP BY product_id, batch_no)
SELECT p.product_id, p.id AS review_id, p.batch_no,
       CASE WHEN l.top > 1500 THEN 'other' WHEN length(text) < 100 THEN 'kyc' WHEN length(text) < 400 THEN 'payments' ELSE 'trading' END AS theme_id,
       CAST(CASE WHEN l.top > 1500 THEN 0.0 ELSE 0.75 END AS DOUBLE) AS confidence
FROM placed p JOIN longest l USING (product_id, batch_no)""")
def scored_assignments(spark, sf_dir):
    """A user scorer over batches of ten in corpus order; a failing batch goes to other."""

    def length_scorer(batch: pd.DataFrame) -> pd.DataFrame:
        """Stands in for a model: themes by text length; refuses batches holding a very long text."""
        lengths = batch["text"].str.len()
        if (lengths > 1500).any():
            raise ValueError("text too long")
        theme = lengths.map(lambda n: "kyc" if n < 100 else "payments" if n < 400 else "trading")
        return pd.DataFrame({"review_id": batch["review_id"], "theme_id": theme, "confidence": 0.75})

    return themes.assign_themes(conversation_reviews(spark, sf_dir), length_scorer).drop("pos")
