"""Review-shaped views of the given tables, in Spark and in SQL.

``events`` gives dated reviews of a hot product and many small ones, ``documents`` raw export
rows with dirty fields and copies, ``conversations`` reviews with short texts and themes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.config import Config, ThemeConfig
from reviewmill.functions.text import strip

EVENT_SEEDS = (
    ("signup", "Sign up & login"),
    ("error", "Errors & crashes"),
    ("click", "Navigation"),
    ("view", "Screens"),
)
EVENT_CONFIG = Config(themes=ThemeConfig(seeds=EVENT_SEEDS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CASE WHEN user_id % 3 = 0 THEN 'p0' ELSE concat('u', user_id) END AS product_id",
        "substring(sha1(CAST(event_id AS STRING)), 1, 12) AS id",
        "'play_store' AS store",
        "CAST(ts AS DATE) AS date",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS INT) END AS rating",
        "event_type AS title",
        "props AS text",
        "CAST(NULL AS STRING) AS app_version",
        "event_type AS theme_raw",
        "event_id",
    )


EV = """
ev AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'p0' ELSE 'u' || CAST(user_id AS VARCHAR) END AS product_id,
         substr(sha1(CAST(event_id AS VARCHAR)), 1, 12) AS id, CAST(ts AS DATE) AS date,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + event_id % 5 END AS rating,
         CASE WHEN event_type IN ('signup', 'error', 'click', 'view') THEN event_type ELSE 'other' END AS theme_id,
         event_type, event_id
  FROM events)"""


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows: one product per language, dates and ratings in many spellings. Copies of a text
    share its length, hence its date and rating, and so its id."""
    day = "date_add(DATE '2024-01-01', CAST(n_chars % 120 AS INT))"
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS product_id",
        "CASE WHEN doc_id % 41 = 0 THEN '  ' ELSE concat(' ', text, '\\n') END AS text",
        f"""CASE n_chars % 9
              WHEN 0 THEN date_format({day}, 'yyyy-MM-dd')
              WHEN 1 THEN concat(date_format({day}, 'yyyy-MM-dd'), ' 10:20:30')
              WHEN 2 THEN concat(date_format({day}, 'yyyy-MM-dd'), 'T10:20:30Z')
              WHEN 3 THEN date_format({day}, 'M/d/yyyy')
              WHEN 4 THEN date_format({day}, 'yyyy/MM/dd')
              WHEN 5 THEN date_format({day}, 'MMM d, yyyy')
              WHEN 6 THEN concat(date_format({day}, 'yyyy-MM-dd'), ' 10:20')
              WHEN 7 THEN CAST(1704067200 + n_chars AS STRING)
              ELSE concat(date_format({day}, 'yyyy-MM-dd'), 'T23:59:59+05:30') END AS date_raw""",
        "concat(' ', lang, ' ') AS title",
        "element_at(array('4.9', '', '3', 'n/a', ' 5 ', '0.5', '1e0'), CAST(n_chars % 7 AS INT) + 1) AS rating_raw",
        "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' 1.2 ' ELSE concat('3.', doc_id % 10) END AS app_version",
        "source AS source_file",
        "doc_id AS row_no",
    )


# Blanks as SQL text, for trimming.
BLANK_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"
FOREIGN_SQL = (
    r"[\x{0900}-\x{0D7F}\x{0600}-\x{06FF}\x{0750}-\x{077F}"
    r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
)


def words_sql(col: str) -> str:
    return rf"len(regexp_extract_all({col}, '[^\s]*[\p{{L}}\p{{N}}][^\s]*'))"


def english_sql(col: str) -> str:
    letters = f"len(regexp_extract_all({col}, '[A-Za-z]'))"
    return rf"""(length({col}) > 0 AND len(regexp_extract_all({col}, '{FOREIGN_SQL}')) < 3
       AND len(regexp_extract_all({col}, '{FOREIGN_SQL}')) < 0.05 * length({col}) AND {letters} >= 8
       AND len(regexp_extract_all({col}, '[\p{{L}}\p{{Nl}}\p{{No}}]')) = {letters})"""


DOC = rf"""
doc_raw AS (
  SELECT lang AS product_id, CASE WHEN doc_id % 41 = 0 THEN '' ELSE trim(text, {BLANK_SQL}) END AS text,
         DATE '2024-01-01' + CAST(n_chars % 120 AS INT) AS day, n_chars, lang AS title,
         CAST(CASE n_chars % 7 WHEN 0 THEN 4 WHEN 2 THEN 3 WHEN 4 THEN 5 WHEN 6 THEN 1 END AS BIGINT) AS rating,
         CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '1.2' ELSE '3.' || CAST(doc_id % 10 AS VARCHAR) END AS app_version,
         source AS source_file, doc_id AS row_no
  FROM documents),
doc_typed AS (
  SELECT *, CASE WHEN n_chars % 9 IN (6, 7) THEN NULL ELSE day END AS date FROM doc_raw),
doc_tested AS (
  SELECT *, CASE WHEN text = '' THEN 'empty_text' WHEN {words_sql('text')} < 8 THEN 'short_text'
                 WHEN NOT {english_sql('text')} THEN 'non_english' WHEN date IS NULL THEN 'bad_date' END AS row_reason,
         substr(sha1(CAST(date AS VARCHAR) || '|' || coalesce(CAST(rating AS VARCHAR), '') || '|' || title || '|' || text), 1, 12) AS id
  FROM doc_typed),
doc_anchor AS (
  SELECT product_id, max(date) AS week_ending FROM doc_tested WHERE row_reason IS NULL GROUP BY product_id),
doc_window AS (
  SELECT t.*, a.week_ending,
         CASE WHEN row_reason IS NOT NULL THEN row_reason
              WHEN date BETWEEN a.week_ending - 28 AND a.week_ending THEN NULL ELSE 'outside_window' END AS window_reason
  FROM doc_tested t LEFT JOIN doc_anchor a USING (product_id)),
doc_marked AS (
  SELECT *, CASE WHEN window_reason IS NULL AND row_number() OVER (
                   PARTITION BY product_id, id, window_reason ORDER BY date, source_file, row_no) > 1
                 THEN 'duplicate' ELSE window_reason END AS drop_reason
  FROM doc_window),
doc_kept AS (SELECT * FROM doc_marked WHERE drop_reason IS NULL)"""

CONV_THEMES = ("onboarding", "kyc", "payments", "trading", "withdrawals", "mystery", "unlisted_theme")


def conversation_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = ", ".join(f"'{t}'" for t in CONV_THEMES)
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "role AS product_id",
        "substring(sha1(concat(conv_id, '-', turn)), 1, 12) AS id",
        "'play_store' AS store",
        "date_add(DATE '2024-01-01', CAST(conv_id % 28 AS INT)) AS date",
        "CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE CAST(1 + (conv_id * 3 + turn) % 5 AS INT) END AS rating",
        "concat(role, ' ', conv_id) AS title",
        "text",
        "CAST(NULL AS STRING) AS app_version",
        f"element_at(array({themes}), CAST((conv_id + turn) % 7 AS INT) + 1) AS theme_raw",
        "conv_id",
        "turn",
    )
    return rows.withColumn("text", strip(F.col("text")))


def conversation_assignments(reviews: DataFrame) -> DataFrame:
    """Assignments of most reviews; every third turn is assigned again later."""
    first = reviews.filter("conv_id % 13 <> 0").selectExpr(
        "product_id",
        "id AS review_id",
        "theme_raw AS theme_id",
        "CAST(conv_id % 5 AS DOUBLE) / 10 + 0.5 AS confidence",
        "CAST(floor(conv_id / 10) AS BIGINT) AS batch_no",
        "CAST((conv_id % 10) * 100 + turn AS INT) AS pos",
    )
    again = reviews.filter("turn % 3 = 0 AND conv_id % 13 <> 0").selectExpr(
        "product_id",
        "id AS review_id",
        "'kyc' AS theme_id",
        "CAST(1.0 AS DOUBLE) AS confidence",
        "1000000 + CAST(floor(conv_id / 10) AS BIGINT) AS batch_no",
        "CAST((conv_id % 10) * 100 + turn AS INT) AS pos",
    )
    return first.unionByName(again)


CONV = f"""
conv AS (
  SELECT role AS product_id, substr(sha1(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)), 1, 12) AS id,
         DATE '2024-01-01' + CAST(conv_id % 28 AS INT) AS date,
         CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE 1 + (conv_id * 3 + turn) % 5 END AS rating,
         role || ' ' || CAST(conv_id AS VARCHAR) AS title, trim(text, {BLANK_SQL}) AS text,
         CASE (conv_id + turn) % 7 WHEN 0 THEN 'onboarding' WHEN 1 THEN 'kyc' WHEN 2 THEN 'payments'
           WHEN 3 THEN 'trading' WHEN 4 THEN 'withdrawals' WHEN 5 THEN 'mystery' ELSE 'unlisted_theme' END AS theme_raw,
         conv_id, turn
  FROM conversations),
conv_assign AS (
  SELECT product_id, id, theme_raw AS theme_id, CAST(conv_id % 5 AS DOUBLE) / 10 + 0.5 AS confidence,
         conv_id // 10 AS batch_no, (conv_id % 10) * 100 + turn AS pos
  FROM conv WHERE conv_id % 13 <> 0
  UNION ALL
  SELECT product_id, id, 'kyc', 1.0, 1000000 + conv_id // 10, (conv_id % 10) * 100 + turn
  FROM conv WHERE turn % 3 = 0 AND conv_id % 13 <> 0),
conv_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, id ORDER BY batch_no DESC, pos DESC) AS from_end,
         row_number() OVER (PARTITION BY product_id, id ORDER BY batch_no, pos) AS from_start
  FROM conv_assign),
conv_recon AS (
  SELECT c.product_id, c.id, c.date, c.rating, c.title, c.text,
         CASE WHEN l.theme_id IN ('onboarding', 'kyc', 'payments', 'trading', 'withdrawals') THEN l.theme_id
              ELSE 'other' END AS theme_id,
         coalesce(l.confidence, 0.0) AS confidence, f.batch_no AS first_batch, f.pos AS first_pos
  FROM conv c
  LEFT JOIN conv_ranked l ON l.product_id = c.product_id AND l.id = c.id AND l.from_end = 1
  LEFT JOIN conv_ranked f ON f.product_id = c.product_id AND f.id = c.id AND f.from_start = 1)"""

CONV_MEMBERS = CONV + """,
conv_sizes AS (
  SELECT product_id, theme_id, count(*) AS size,
         min(coalesce(first_batch, 1000000000) * 100000 + coalesce(first_pos, 0)) AS seen
  FROM conv_recon GROUP BY product_id, theme_id),
conv_cap AS (
  SELECT product_id, theme_id,
         CASE WHEN count(*) OVER (PARTITION BY product_id) > 5 AND row_number() OVER (
                PARTITION BY product_id ORDER BY theme_id = 'other', size DESC, seen DESC) > 4
              THEN 'other' ELSE theme_id END AS merged
  FROM conv_sizes),
conv_members AS (
  SELECT r.product_id, r.id, r.date, r.rating, r.title, r.text, c.merged AS theme_id
  FROM conv_recon r JOIN conv_cap c USING (product_id, theme_id))"""


def mean_sql(total: str, count: str) -> str:
    """A mean with two correctly rounded decimals."""
    return f"CASE WHEN {count} > 0 THEN CAST(printf('%.2f', {total} / {count}) AS DOUBLE) END"


def windows_sql(reviews: str, weeks: str, name: str) -> str:
    """CTE ``name`` with the windows of ``weeks`` (product_id, week_ending) over ``reviews``."""
    return f"""
{name}_counts AS (
  SELECT w.product_id, w.week_ending,
         count(*) FILTER (WHERE r.date >= w.week_ending - 6) AS n7, count(*) FILTER (WHERE r.date >= w.week_ending - 27) AS n28,
         count(r.id) AS corpus_n,
         count(r.rating) FILTER (WHERE r.date >= w.week_ending - 6) AS rated7, count(r.rating) FILTER (WHERE r.date >= w.week_ending - 27) AS rated28,
         coalesce(sum(r.rating) FILTER (WHERE r.date >= w.week_ending - 6), 0) AS sum7, coalesce(sum(r.rating) FILTER (WHERE r.date >= w.week_ending - 27), 0) AS sum28
  FROM {weeks} w LEFT JOIN {reviews} r ON r.product_id = w.product_id AND r.date BETWEEN w.week_ending - 28 AND w.week_ending
  GROUP BY w.product_id, w.week_ending),
{name} AS (
  SELECT product_id, week_ending, week_ending - 28 AS corpus_from, week_ending AS corpus_to,
         CASE WHEN n7 < 15 THEN week_ending - 27 ELSE week_ending - 6 END AS reporting_from, week_ending AS reporting_to,
         CASE WHEN n7 < 15 THEN '4-week rollup (low weekly volume)' END AS window_note,
         CASE WHEN n7 < 15 THEN n28 ELSE n7 END AS review_count_week, corpus_n AS review_count_corpus,
         {mean_sql('(CASE WHEN n7 < 15 THEN sum28 ELSE sum7 END)', '(CASE WHEN n7 < 15 THEN rated28 ELSE rated7 END)')} AS avg_rating_week
  FROM {name}_counts)"""


def stats_sql(members: str, windows: str, name: str, labels: dict[str, str]) -> str:
    """CTE ``name`` with ranked theme statistics."""
    cases = " ".join(f"WHEN '{key}' THEN '{label}'" for key, label in labels.items())
    return f"""
{name}_sums AS (
  SELECT w.product_id, w.week_ending, m.theme_id, count(*) AS count_corpus,
         count(*) FILTER (WHERE m.date >= w.reporting_from) AS count_week,
         count(m.rating) FILTER (WHERE m.date >= w.reporting_from) AS rated,
         sum(m.rating) FILTER (WHERE m.date >= w.reporting_from) AS total
  FROM {windows} w JOIN {members} m ON m.product_id = w.product_id AND m.date BETWEEN w.corpus_from AND w.corpus_to
  GROUP BY w.product_id, w.week_ending, m.theme_id),
{name}_base AS (
  SELECT product_id, week_ending, theme_id, CASE theme_id {cases} WHEN 'other' THEN 'Unclassified' END AS label,
         count_corpus, count_week, {mean_sql('total', 'rated')} AS avg_rating_week,
         CAST(printf('%.2f', count_corpus / 4) AS DOUBLE) AS baseline_weekly
  FROM {name}_sums),
{name} AS (
  SELECT *, CASE WHEN baseline_weekly <= 0 THEN CASE WHEN count_week > 0 THEN 'rising' ELSE 'steady' END
                 WHEN count_week / baseline_weekly >= 1.25 THEN 'rising'
                 WHEN count_week / baseline_weekly <= 0.75 THEN 'falling' ELSE 'steady' END AS trend,
         row_number() OVER (PARTITION BY product_id, week_ending
                            ORDER BY count_week DESC, avg_rating_week ASC NULLS LAST, theme_id) AS rank
  FROM {name}_base)"""


def top_sql(stats: str, name: str) -> str:
    return f"""
{name}_real AS (
  SELECT *, count(*) FILTER (WHERE theme_id <> 'other') OVER (PARTITION BY product_id, week_ending) AS real_n,
         CASE WHEN theme_id <> 'other' THEN row_number() OVER (
           PARTITION BY product_id, week_ending, theme_id <> 'other' ORDER BY rank) END AS real_rank
  FROM {stats}),
{name} AS (
  SELECT * EXCLUDE (rank, real_n, real_rank), CASE WHEN real_n >= 3 THEN real_rank ELSE rank END AS rank
  FROM {name}_real WHERE CASE WHEN real_n >= 3 THEN real_rank ELSE rank END <= 3)"""


EVENT_LABELS = dict(EVENT_SEEDS)
SEED_LABELS = {
    "onboarding": "Onboarding & demat",
    "kyc": "KYC & verification",
    "payments": "Payments & UPI",
    "trading": "Trading & orders",
    "withdrawals": "Withdrawals & payouts",
}
EV_ANCHOR = "ev_week AS (SELECT product_id, max(date) AS week_ending FROM ev GROUP BY product_id)"
CONV_ANCHOR = "conv_week AS (SELECT product_id, max(date) AS week_ending FROM conv GROUP BY product_id)"
EV_STATS = ",".join(
    (EV, EV_ANCHOR, windows_sql("ev", "ev_week", "ev_win"), stats_sql("ev", "ev_win", "ev_stats", EVENT_LABELS))
)
CONV_STATS = ",".join(
    (
        CONV_MEMBERS,
        CONV_ANCHOR,
        windows_sql("conv", "conv_week", "conv_win"),
        stats_sql("conv_members", "conv_win", "conv_stats", SEED_LABELS),
        top_sql("conv_stats", "conv_top"),
    )
)
