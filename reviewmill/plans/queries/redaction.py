"""Queries over personal data: redacted texts, counts, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.operators.redaction import redact_reviews, redaction_report, scan_pii
from reviewmill.plans.queries.inputs import conversation_reviews, document_rows, table
from reviewmill.plans.queries.registry import query


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("lang AS product_id", "doc_id", "source AS title", "text")


@query()
def redacted_reviews(spark, sf_dir):
    return redact_reviews(_documents(spark, sf_dir)).select("doc_id", "title", "text", "redactions", "redacted")


@query()
def redaction_totals(spark, sf_dir):
    return redaction_report(redact_reviews(_documents(spark, sf_dir)))


@query(r"""
SELECT page_id, len(regexp_extract_all(body, '(?i)https?://[^\s<>"'']+|www\.[^\s<>"'']+')) AS links,
       regexp_replace(body, '(?i)https?://[^\s<>"'']+|www\.[^\s<>"'']+', '[link]', 'g') AS text
FROM (SELECT page_id, 'visit ' || url || ' or ' || replace(url, 'https', 'HTTPS') || ' now' AS body FROM pages)""")
def redacted_links(spark, sf_dir):
    """Page addresses inside a sentence; digits in a path must not stop the link pattern."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('visit ', url, ' or ', replace(url, 'https', 'HTTPS'), ' now') AS text"
    )
    return redact_reviews(pages, ["text"]).select("page_id", F.col("redactions.link").alias("links"), "text")


@query(r"""
SELECT user_id, event_id, len(regexp_extract_all(body, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS emails,
       'write to [email] or [handle], paid INR ' || CAST(event_id AS VARCHAR) || '.50 on v' || CAST(user_id AS VARCHAR) || '.2' AS text
FROM (SELECT user_id, event_id, 'write to u.' || event_type || '@mail.example.com' AS body FROM events)""")
def redacted_contacts(spark, sf_dir):
    """An address, a handle, an amount and a version per event; amount and version stay."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").selectExpr(
        "user_id",
        "event_id",
        """concat('write to u.', event_type, '@mail.example.com or @user_', user_id, ', paid INR ',
                  event_id, '.50 on v', user_id, '.2') AS text""",
    )
    return redact_reviews(rows, ["text"]).select(
        "user_id", "event_id", F.col("redactions.email").alias("emails"), "text"
    )


_NUMBERS = """concat('call +91 (0) 98 ', lpad(CAST({0} AS STRING), 8, '0'), ', order x', lpad(CAST({0} AS STRING), 9, '7'), 'y or k7k7k7k7k7k7',
                  {0} % 10, ', 5 stars, Rs. 1,500.75 on 2.0{1}\\n- Ann B.')"""


@query("""
SELECT event_id, CAST(1 AS BIGINT) AS phones, CAST(2 AS BIGINT) AS ids, CAST(1 AS BIGINT) AS names,
       'call [phone], order x[id]y or [id], 5 stars, Rs. 1,500.75 on 2.0' || CASE WHEN event_id % 2 = 0 THEN ' é' ELSE '' END || ' [name]' AS text,
       ['phone', 'id'] AS found
FROM events""")
def redacted_numbers(spark, sf_dir):
    """A phone number, two ids and a signature per event, every other text beyond ASCII; stars, amount and version stay."""
    bodies = [_NUMBERS.format("event_id", ""), _NUMBERS.format("event_id", " é")]
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"CASE WHEN event_id % 2 = 0 THEN {bodies[1]} ELSE {bodies[0]} END AS text"
    )
    clean = redact_reviews(scan_pii(rows, "text"), ["text"])
    kinds = ("phone", "id", "name")
    counts = [F.col(f"redactions.{kind}").alias(f"{kind}s") for kind in kinds]
    return clean.select("event_id", *counts, "text", F.transform("pii_hits", lambda h: h["category"]).alias("found"))


@query(r"""
SELECT page_id, len(regexp_extract_all(url, '(?i)https?://[^\s<>"'']+|www\.[^\s<>"'']+')) AS hits FROM pages""")
def link_scan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hit = F.filter("pii_hits", lambda h: h["category"] == "link")
    return scan_pii(pages, "url").select("page_id", F.coalesce(F.get(hit, 0)["hits"], F.lit(0)).alias("hits"))


@query()
def pii_scan(spark, sf_dir):
    return scan_pii(_documents(spark, sf_dir), "text").select("doc_id", "pii_hits")


@query("SELECT doc_id AS row_no, 'email' AS category, CAST(1 AS BIGINT) AS hits FROM documents WHERE doc_id % 3 = 0")
def redacted_leftovers(spark, sf_dir):
    """What a scan finds after redaction: an address put into every third text since, nothing else."""
    clean = redact_reviews(document_rows(spark, sf_dir).selectExpr("row_no", "title", "trim(text) AS text"))
    planted = F.concat("text", F.when(F.col("row_no") % 3 == 0, " ask some.one@mail.example").otherwise(""))
    found = scan_pii(clean.withColumn("text", planted), "text")
    return found.select("row_no", F.explode("pii_hits").alias("h")).select("row_no", "h.category", F.col("h.hits").cast("bigint").alias("hits"))


@query()
def redacted_conversations(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    return redact_reviews(reviews).select("product_id", "id", "title", "text", "redactions", "redacted")
