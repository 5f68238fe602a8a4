"""Queries over raw rows: tests, drops, windows, de-duplication, import."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.functions import text
from reviewmill.functions.language import guess
from reviewmill.operators import clean
from reviewmill.operators.language import learn_profile
from reviewmill.operators.ordering import corpus_position
from reviewmill.operators.windows import compute_windows, daily_rollup, in_window
from reviewmill.plans.ingest import ingest_reviews
from reviewmill.plans.queries.inputs import (
    BLANK_SQL,
    DOC,
    EV,
    EV_ANCHOR,
    FOREIGN_SQL,
    document_rows,
    english_sql,
    event_reviews,
    table,
    windows_sql,
    words_sql,
)
from reviewmill.plans.queries.registry import query
from reviewmill.scale import cut_lineage


@query(rf"""
SELECT doc_id, {words_sql('text')} AS words, len(regexp_extract_all(text, '{FOREIGN_SQL}')) AS other_script,
       len(regexp_extract_all(text, '[A-Za-z]')) AS latin, {english_sql('text')} AS english, length(text) > 0 AS has_text
FROM (SELECT doc_id, trim(text, {BLANK_SQL}) AS text FROM documents)
""")
def text_signals(spark, sf_dir):
    t = text.strip(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.word_count(t).alias("words"),
        text.other_script_chars(t).alias("other_script"),
        text.latin_letters(t).alias("latin"),
        text.is_english(t).alias("english"),
        (F.length(t) > 0).alias("has_text"),
    )


@query(rf"""
WITH texts AS (
  SELECT doc_id, lang, trim(text, {BLANK_SQL}) AS body,
         CASE WHEN regexp_matches(text, '\p{{L}}') THEN ' ' || trim(regexp_replace(lower(trim(text, {BLANK_SQL})), '[^\p{{L}}]+', ' ', 'g')) || ' ' END AS t
  FROM documents),
coded AS (SELECT doc_id, lang, list_transform(string_split(t, ''), lambda x: unicode(x)) AS c FROM texts WHERE t IS NOT NULL),
grams AS (
  SELECT doc_id, lang, ((c[i] * 31 + c[i + 1]) * 31 + c[i + 2]) % 32768 AS bucket
  FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM coded)),
langs AS (SELECT lang, count(*) AS total FROM grams WHERE lang IS NOT NULL GROUP BY lang),
counts AS (SELECT lang, bucket, count(*) AS n FROM grams GROUP BY lang, bucket),
weights AS (
  SELECT l.lang, b.bucket, CAST(floor(ln((coalesce(n, 0) + 1) / (total + 32768)) * 1000) AS BIGINT) AS w
  FROM langs l CROSS JOIN (SELECT unnest(range(32768)) AS bucket) b LEFT JOIN counts c ON c.lang = l.lang AND c.bucket = b.bucket),
sums AS (
  SELECT doc_id, w.lang, CAST(sum(n * w.w) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS trigrams
  FROM (SELECT doc_id, bucket, count(*) AS n FROM grams GROUP BY doc_id, bucket) g JOIN weights w USING (bucket) GROUP BY doc_id, w.lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS place FROM sums),
best AS (
  SELECT doc_id, max(lang) FILTER (WHERE place = 1) AS language, max(s) AS score, max(s) - max(s) FILTER (WHERE place = 2) AS margin,
         max(trigrams) AS trigrams, 1 / sum(exp((s - top) / 1000)) AS prob
  FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS top FROM ranked) GROUP BY doc_id)
SELECT doc_id, language, score, margin, trigrams,
       len(regexp_extract_all(body, '{FOREIGN_SQL}')) < 3 AND len(regexp_extract_all(body, '{FOREIGN_SQL}')) < 0.05 * length(body)
       AND len(regexp_extract_all(body, '[A-Za-z]')) >= 5 AND coalesce(language = 'en' AND prob >= 0.5, false) AS english
FROM texts LEFT JOIN best USING (doc_id)
""")
def detected_language(spark, sf_dir):
    """The language of every document by a profile learnt from all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", text.strip(F.col("text")).alias("text"))
    detector = guess(learn_profile(docs))
    found = docs.select("doc_id", detector(F.col("text")).alias("g"), text.is_english(F.col("text"), detector).alias("english"))
    return found.select("doc_id", F.col("g.lang").alias("language"), "g.score", "g.margin", "g.trigrams", "english")


@query(f"WITH {DOC} SELECT product_id, date, rating, title, text, app_version, source_file, row_no FROM doc_tested")
def review_projection(spark, sf_dir):
    return clean.project_reviews(document_rows(spark, sf_dir)).drop("store", "drop_reason", "id")


@query(f"WITH {DOC} SELECT row_no, id FROM doc_tested WHERE row_reason IS NULL")
def surrogate_ids(spark, sf_dir):
    rows = clean.project_reviews(document_rows(spark, sf_dir))
    return rows.filter("drop_reason IS NULL").select("row_no", "id")


@query(f"WITH {DOC} SELECT source_file, row_no, product_id, coalesce(drop_reason, 'kept') AS outcome FROM doc_marked")
def drop_reasons(spark, sf_dir):
    marked = clean.mark_corpus_window(clean.project_reviews(document_rows(spark, sf_dir)))
    return clean.mark_duplicates(marked).select(
        "source_file", "row_no", "product_id", F.coalesce("drop_reason", F.lit("kept")).alias("outcome")
    )


@query(f"WITH {DOC} SELECT product_id, id, date, rating, title, text, app_version FROM doc_kept")
def ingested_reviews(spark, sf_dir):
    return ingest_reviews(document_rows(spark, sf_dir)).reviews.select(
        "product_id", "id", "date", "rating", "title", "text", "app_version"
    )


@query(f"""WITH {DOC}, {windows_sql('doc_kept', 'doc_anchor', 'doc_win')},
counts AS (
  SELECT product_id, count(*) AS rows_read, count(*) FILTER (WHERE drop_reason IS NULL) AS rows_kept,
         count(*) FILTER (WHERE drop_reason = 'empty_text') AS rows_dropped_empty_text,
         count(*) FILTER (WHERE drop_reason = 'short_text') AS rows_dropped_short_text,
         count(*) FILTER (WHERE drop_reason = 'non_english') AS rows_dropped_non_english,
         count(*) FILTER (WHERE drop_reason = 'bad_date') AS rows_dropped_bad_date,
         count(*) FILTER (WHERE drop_reason = 'outside_window') AS rows_dropped_outside_window,
         count(*) FILTER (WHERE drop_reason = 'duplicate') AS rows_dropped_duplicate,
         min(date) FILTER (WHERE drop_reason IS NULL) AS date_min, max(date) FILTER (WHERE drop_reason IS NULL) AS date_max
  FROM doc_marked GROUP BY product_id)
SELECT c.*, w.week_ending, w.corpus_from, w.corpus_to, w.reporting_from, w.reporting_to, w.window_note, w.review_count_week
FROM counts c LEFT JOIN doc_win w USING (product_id)""")
def ingest_report(spark, sf_dir):
    return ingest_reviews(document_rows(spark, sf_dir)).report


@query(f"WITH {EV}, {EV_ANCHOR} SELECT product_id, week_ending FROM ev_week")
def anchor_dates(spark, sf_dir):
    return clean.anchor_dates(event_reviews(spark, sf_dir))


@query(f"""WITH {EV}, {EV_ANCHOR}
SELECT product_id, week_ending, count(*) AS n, min(date) AS first_day, max(date) AS last_day
FROM ev JOIN ev_week USING (product_id) WHERE date BETWEEN week_ending - 28 AND week_ending GROUP BY product_id, week_ending""")
def corpus_window(spark, sf_dir):
    rows = event_reviews(spark, sf_dir).withColumn("drop_reason", F.lit(None).cast("string"))
    inside = clean.mark_corpus_window(rows).filter("drop_reason IS NULL")
    return inside.groupBy("product_id", "week_ending").agg(
        F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


_WEEKS = """ev_weeks AS (
  SELECT product_id, week_ending - 7 * k AS week_ending
  FROM ev_week, (SELECT unnest([0, 1, 2]) AS k))"""


@query(f"""WITH {EV}, {EV_ANCHOR}, {_WEEKS}, {windows_sql('ev', 'ev_weeks', 'ev_win')} SELECT * FROM ev_win""")
def reporting_windows(spark, sf_dir):
    """Three weeks of every product at once, with the thin-week fallback."""
    daily = cut_lineage(daily_rollup(event_reviews(spark, sf_dir)))
    newest = daily.groupBy("product_id").agg(F.max("date").alias("newest"))
    weeks = newest.select(
        "product_id", F.explode(F.sequence("newest", F.date_sub("newest", 14), F.expr("interval -7 days"))).alias("week_ending")
    )
    return compute_windows(daily, weeks)


@query(f"""WITH {EV}, {EV_ANCHOR}, {_WEEKS}, {windows_sql('ev', 'ev_weeks', 'ev_win')}
SELECT r.id, w.product_id, w.week_ending FROM ev r JOIN ev_win w ON r.product_id = w.product_id
 AND r.date BETWEEN w.reporting_from AND w.reporting_to""")
def reviews_per_window(spark, sf_dir):
    reviews = event_reviews(spark, sf_dir).select("product_id", "id", "date")
    return in_window(reviews, reporting_windows(spark, sf_dir)).select("id", "product_id", "week_ending")


@query(f"""WITH {DOC}
SELECT product_id, id, min(CAST(source_file AS VARCHAR) || '/' || lpad(CAST(row_no AS VARCHAR), 12, '0')) AS first_row, count(*) AS copies
FROM doc_tested WHERE row_reason IS NULL GROUP BY product_id, id""")
def dedup_reviews(spark, sf_dir):
    rows = clean.project_reviews(document_rows(spark, sf_dir)).filter("drop_reason IS NULL")
    first = F.concat("source_file", F.lit("/"), F.lpad(F.col("row_no").cast("string"), 12, "0"))
    return clean.deduplicate(rows).select("product_id", "id", first.alias("first_row"), "copies")


@query(f"WITH {EV} SELECT product_id, id, row_number() OVER (PARTITION BY product_id ORDER BY date, id) - 1 AS pos FROM ev")
def corpus_order(spark, sf_dir):
    return corpus_position(event_reviews(spark, sf_dir).select("product_id", "date", "id")).drop("date")


@query(f"""
WITH seen AS (
  SELECT doc_id, source, n_chars, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha1(text) END AS source_id FROM documents
  WHERE length(trim(text, {BLANK_SQL})) > 0)
SELECT doc_id, source_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS rn FROM seen) WHERE rn = 1 OR source_id IS NULL""")
def first_seen(spark, sf_dir):
    """Crawled rows by source id: first copy kept, rows without an id all kept."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE sha1(text) END AS source_id", "text"
    )
    return clean.first_seen(rows, "source_id", ["doc_id"], "text").select("doc_id", "source_id")


@query("""
SELECT event_id, event_type IN ('view', 'click') AS is_play
FROM events""")
def store_whitelist(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN 'Android' WHEN 'click' THEN NULL ELSE 'ios' END AS store"
    )
    return rows.select("event_id", clean.is_play_store(F.col("store")).alias("is_play"))


@query(f"WITH {EV} SELECT product_id, bool_or(event_id % 977 = 5) AS non_play_data FROM ev GROUP BY product_id")
def store_purity(spark, sf_dir):
    rows = event_reviews(spark, sf_dir).withColumn(
        "store", F.expr("CASE WHEN event_id % 977 = 5 THEN 'app_store' ELSE 'play_store' END")
    )
    return clean.store_purity(rows)


@query("""
SELECT event_type AS product_id, CAST(event_id AS VARCHAR) AS text, CASE event_id % 5
         WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         ELSE 'day ' || CAST(event_id AS VARCHAR) END AS date_raw,
       CAST(value AS VARCHAR) AS rating_raw, '' AS title, '' AS app_version, 'events' AS source_file, event_id AS row_no
FROM events""")
def table_import(spark, sf_dir):
    """A foreign table by column synonyms, with its timestamps in several spellings."""
    foreign = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts").selectExpr(
        "event_id",
        "event_type",
        "CAST(event_id AS STRING) AS Content",
        "value AS Score",
        """CASE event_id % 5 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
             WHEN 1 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS STRING)
             WHEN 2 THEN date_format(ts, 'dd-MM-yyyy')
             WHEN 3 THEN CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS STRING)
             ELSE concat('day ', event_id) END AS at""",
    )
    return clean.import_rows(foreign, F.col("event_type"), "events", F.col("event_id"))


@query("""
SELECT 'doc' AS source_file, doc_id AS row_no, text FROM documents
UNION ALL SELECT 'item', item_id, text FROM benchmark
UNION ALL SELECT 'conv', conv_id * 1000 + turn, text FROM conversations""")
def union_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("'doc' AS source_file", "doc_id AS row_no", "text")
    items = table(spark, sf_dir, "benchmark").selectExpr("'item' AS source_file", "item_id AS row_no", "text")
    talks = table(spark, sf_dir, "conversations").selectExpr(
        "text", "'conv' AS source_file", "conv_id * 1000 + turn AS row_no"
    )
    return clean.union_sources(docs, items, talks)


@query("""
SELECT event_type AS product_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS date_min, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS date_max
FROM events GROUP BY event_type""")
def export_date_range(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_type AS product_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS at"
    )
    return clean.date_range(rows, "at")
