"""Queries over quotes, reports and their validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from reviewmill.config import DEFAULT
from reviewmill.functions import render
from reviewmill.operators import quotes, reports, validation
from reviewmill.operators.redaction import redact_reviews, redaction_report
from reviewmill.plans.ingest import ingest_reviews
from reviewmill.operators.themes import week_members
from reviewmill.plans.queries.inputs import CONV_STATS, table, top_sql
from reviewmill.plans.queries.registry import query
from reviewmill.plans.queries.themes import WEEKLY, conversation_build, weekly_build
from reviewmill.plans.summary import run_summary
from reviewmill.plans.weekly import publishable
from reviewmill.scale import cut_lineage

# The markers that make a text unfit for quoting, as SQL.
_MARKERS = r"(?i)\[(email|phone|id|link|handle|name|redacted)\]"

ELIGIBLE = CONV_STATS + f""",
conv_elig AS (
  SELECT t.product_id, t.week_ending, t.theme_id, m.id, m.date, m.rating, m.title, m.text,
         abs(coalesce(m.rating, 3) - coalesce(t.avg_rating_week, 3.0)) AS distance
  FROM conv_members m JOIN conv_top t USING (product_id, theme_id) JOIN conv_win w USING (product_id, week_ending)
  WHERE m.date BETWEEN w.reporting_from AND w.reporting_to AND length(m.text) BETWEEN 40 AND 200
    AND NOT regexp_matches(m.text, '{_MARKERS}')),
conv_quotes AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, week_ending, theme_id ORDER BY distance, id) AS rank FROM conv_elig)"""

# Model output stands in as tables: a summary per theme with a rating, the best-ranked quote of
# each theme, and an action per theme.
REPORTS = ELIGIBLE + """,
conv_summaries AS (
  SELECT product_id, week_ending, theme_id, 'Users wrote *' || CAST(count_week AS VARCHAR) || '* reviews on ' || label || '.' AS summary
  FROM conv_top WHERE avg_rating_week IS NOT NULL),
conv_picks AS (
  SELECT product_id, week_ending, theme_id, id AS review_id, text, rating, date, title FROM conv_quotes WHERE rank = 1),
conv_themes_txt AS (
  SELECT product_id, week_ending, count(*) AS n_themes,
         string_agg(CAST(rank AS VARCHAR) || '. **' || label || ' — ' || CAST(count_week AS VARCHAR) || ' reviews, ' ||
           CASE WHEN avg_rating_week IS NULL THEN 'avg n/a' ELSE 'avg ' || printf('%.1f', avg_rating_week) || '★' END || ', ' ||
           CASE trend WHEN 'rising' THEN '↑ rising' WHEN 'falling' THEN '↓ falling' ELSE '→ steady' END || '.** ' ||
           coalesce(summary, ''), chr(10) ORDER BY rank) AS theme_lines,
         string_agg(CAST(rank AS VARCHAR) || '. ' || label || chr(10) || '   ' || coalesce(summary, 'No summary available.'),
                    chr(10) || chr(10) ORDER BY rank) AS theme_blocks,
         string_agg(CAST(rank AS VARCHAR) || '. **Improve ' || label || '.** Look at theme ' || theme_id || ' first.', chr(10) ORDER BY rank) AS action_lines,
         string_agg(CAST(rank AS VARCHAR) || '. Improve ' || label || chr(10) || '   Look at theme ' || theme_id || ' first.',
                    chr(10) || chr(10) ORDER BY rank) AS action_blocks,
         string_agg(coalesce(summary, '') || ' Improve ' || label || ' Look at theme ' || theme_id || ' first.', ' ') AS prose
  FROM conv_top LEFT JOIN conv_summaries USING (product_id, week_ending, theme_id) GROUP BY product_id, week_ending),
conv_quotes_txt AS (
  SELECT product_id, week_ending, count(*) AS n_quotes, string_agg('> "' || text || '"', chr(10) ORDER BY rank) AS quote_lines,
         string_agg(text, ' ') AS prose
  FROM (SELECT p.*, t.rank FROM conv_picks p JOIN conv_top t USING (product_id, week_ending, theme_id)) GROUP BY product_id, week_ending),
conv_reports AS (
  SELECT w.*, t.n_themes, coalesce(q.n_quotes, 0) AS n_quotes, t.theme_lines, t.theme_blocks, t.action_lines, t.action_blocks,
         coalesce(q.quote_lines, '') AS quote_lines,
         len(regexp_extract_all(regexp_replace(t.prose || ' ' || coalesce(q.prose, ''), '[*_`>"#]', ' ', 'g'), '[^\\s]*[A-Za-z0-9][^\\s]*')) AS body_words
  FROM conv_win w LEFT JOIN conv_themes_txt t USING (product_id, week_ending) LEFT JOIN conv_quotes_txt q USING (product_id, week_ending))"""


def conversation_eligible(spark, sf_dir):
    reviews, windows, built = conversation_build(spark, sf_dir)
    return quotes.eligible_quotes(built.members, windows, built.top, mapping=built.mapping)


def conversation_pool(spark, sf_dir):
    return quotes.quote_pool(conversation_eligible(spark, sf_dir))


def conversation_reports(spark, sf_dir):
    """Reports over stand-in model output; returns reviews, themes and report rows."""
    reviews, windows, built = conversation_build(spark, sf_dir)
    top = built.top
    key = ["product_id", "week_ending", "theme_id"]
    text = F.concat(
        F.lit("Users wrote *"), F.col("count_week").cast("string"), F.lit("* reviews on "), "label", F.lit(".")
    )
    summaries = top.filter("avg_rating_week IS NOT NULL").select(*key, text.alias("summary"), F.lit(1).alias("pos"))
    best = quotes.rank_quotes(quotes.eligible_quotes(built.members, windows, top, mapping=built.mapping), 1)
    picks = best.join(top.select(*key, F.col("rank").alias("pos")), key).select(
        *key, "pos", F.col("id").alias("review_id")
    )
    actions = top.select(
        *key,
        F.col("rank").alias("pos"),
        F.concat(F.lit("Improve "), "label").alias("title"),
        F.concat(F.lit("Look at theme "), "theme_id", F.lit(" first.")).alias("detail"),
    )
    rows = reports.assemble_reports(top, summaries, cut_lineage(picks), actions, reviews, windows)
    return reviews, built, cut_lineage(rows)


@query(rf"""
SELECT doc_id, length(t) BETWEEN 40 AND 200 AND NOT regexp_matches(t, '{_MARKERS}') AS quotable
FROM (SELECT doc_id, trim(replace(text, source, '[Email]'), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM documents)""")
def quote_eligibility(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", "source", F.lit("[Email]")))
    return rows.select("doc_id", quotes.quotable(F.col("text")).alias("quotable"))


@query(f"WITH {ELIGIBLE} SELECT product_id, week_ending, theme_id, id, distance, rank FROM conv_quotes")
def quote_ranking(spark, sf_dir):
    return quotes.rank_quotes(conversation_eligible(spark, sf_dir)).select(
        "product_id", "week_ending", "theme_id", "id", "distance", "rank"
    )


@query(f"WITH {ELIGIBLE} SELECT product_id, week_ending, theme_id, id, rank FROM conv_quotes WHERE rank <= 8")
def quote_candidates(spark, sf_dir):
    """The first eight candidates per theme before near copies are removed."""
    return quotes.rank_quotes(conversation_eligible(spark, sf_dir), 8).select(
        "product_id", "week_ending", "theme_id", "id", "rank"
    )


@query()
def quote_pool(spark, sf_dir):
    return conversation_pool(spark, sf_dir)


@query(f"""WITH {ELIGIBLE}, texts AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, week_ending, theme_id, lower(text) ORDER BY distance, id) AS copy FROM conv_quotes),
kept AS (
  SELECT product_id, week_ending, theme_id, id,
         row_number() OVER (PARTITION BY product_id, week_ending, theme_id ORDER BY distance, id) AS rank FROM texts WHERE copy = 1)
SELECT * FROM kept WHERE rank <= 8""")
def exact_quote_pool(spark, sf_dir):
    """The pool where only texts equal in lower case are near copies."""
    pool = quotes.quote_pool(conversation_eligible(spark, sf_dir), replace(DEFAULT.note, similarity=1.0))
    return pool.select("product_id", "week_ending", "theme_id", "id", "rank")


@query()
def document_quote_pool(spark, sf_dir):
    """Quotes from whole documents of any length above forty characters, near copies removed."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "lang AS product_id",
        "DATE '2024-01-28' AS week_ending",
        "source AS theme_id",
        "substring(sha1(CAST(doc_id AS STRING)), 1, 12) AS id",
        "DATE '2024-01-28' AS date",
        "CAST(1 + doc_id % 5 AS INT) AS rating",
        "text",
        "CAST(abs(1 + doc_id % 5 - 3) AS DOUBLE) AS distance",
    )
    return quotes.quote_pool(rows.filter(quotes.quotable(F.col("text"))))


@query(f"""WITH {REPORTS}
SELECT product_id, week_ending, corpus_from, corpus_to, reporting_from, reporting_to, window_note, review_count_week,
       review_count_corpus, avg_rating_week, n_themes, n_quotes, n_themes AS n_actions, body_words AS body_word_count FROM conv_reports""")
def report_assembly(spark, sf_dir):
    rows = conversation_reports(spark, sf_dir)[2]
    return rows.select(
        "product_id",
        "week_ending",
        F.col("corpus_window.from").alias("corpus_from"),
        F.col("corpus_window.to").alias("corpus_to"),
        F.col("reporting_window.from").alias("reporting_from"),
        F.col("reporting_window.to").alias("reporting_to"),
        "window_note",
        "review_count_week",
        "review_count_corpus",
        "avg_rating_week",
        F.size("top_themes").alias("n_themes"),
        F.size("quotes").alias("n_quotes"),
        F.size("actions").alias("n_actions"),
        "body_word_count",
    )


@query(f"""WITH {REPORTS}, grouped AS (
  SELECT *, CASE WHEN review_count_corpus >= 1000 THEN CAST(review_count_corpus // 1000 AS VARCHAR) || ',' ||
    lpad(CAST(review_count_corpus % 1000 AS VARCHAR), 3, '0') ELSE CAST(review_count_corpus AS VARCHAR) END AS corpus_txt FROM conv_reports)
SELECT product_id, week_ending, '# Weekly Review Report — ' || product_id || ' — week ending ' || CAST(week_ending AS VARCHAR) || chr(10) ||
  'Play Store · com.example.app · ' || CAST(review_count_week AS VARCHAR) || ' reviews · ' || CAST(day(reporting_from) AS VARCHAR) || '–' ||
  CAST(day(reporting_to) AS VARCHAR) || ' ' || strftime(reporting_to, '%b') || ' · ' ||
  CASE WHEN avg_rating_week IS NULL THEN 'avg n/a' ELSE 'avg ' || printf('%.1f', avg_rating_week) || '★' END ||
  ' (corpus: ' || corpus_txt || ' reviews / 4 weeks)' || chr(10) ||
  CASE WHEN window_note IS NULL THEN '' ELSE '*' || window_note || '*' || chr(10) END || chr(10) || '## Top themes' || chr(10) || theme_lines ||
  chr(10) || chr(10) || '## What users said' || chr(10) || CASE WHEN quote_lines = '' THEN '' ELSE quote_lines || chr(10) END || chr(10) ||
  '## Action ideas' || chr(10) || action_lines || chr(10) AS md
FROM grouped""")
def report_markdown(spark, sf_dir):
    rows = conversation_reports(spark, sf_dir)[2]
    return rows.select(
        "product_id", "week_ending", render.report_markdown(package_id="com.example.app").alias("md")
    )


@query(f"""WITH {REPORTS}
SELECT product_id, week_ending, 'Dear Sir/Madam,' || chr(10) || chr(10) || 'Please find the highlights of the Weekly Review Report for ' ||
  product_id || ' for the week ending ' || CAST(week_ending AS VARCHAR) || '.' || chr(10) || chr(10) || 'Snapshot: average rating ' ||
  CASE WHEN avg_rating_week IS NULL THEN 'n/a' ELSE printf('%.1f', avg_rating_week) || '★' END || ' · ' || CAST(review_count_week AS VARCHAR) ||
  ' Play Store reviews' || chr(10) || chr(10) || 'Top themes' || chr(10) || theme_blocks || chr(10) || chr(10) || 'Action items' || chr(10) ||
  action_blocks || chr(10) || chr(10) || 'Regards' || chr(10) || 'Weekly Review Report' || chr(10) AS letter,
  'Reviews, week ending ' || CAST(week_ending AS VARCHAR) AS subject
FROM conv_reports""")
def summary_letter(spark, sf_dir):
    rows = conversation_reports(spark, sf_dir)[2]
    return rows.select(
        "product_id",
        "week_ending",
        render.summary_letter().alias("letter"),
        render.fill_week("Reviews, week ending {week_ending}", F.col("week_ending")).alias("subject"),
    )


@query(f"""WITH {REPORTS}
SELECT product_id, week_ending, theme_id, p.review_id, p.text,
       'Improve ' || t.label AS action FROM conv_top t LEFT JOIN conv_picks p USING (product_id, week_ending, theme_id)""")
def first_quote_and_action(spark, sf_dir):
    key = ["product_id", "week_ending", "theme_id"]
    rows = conversation_reports(spark, sf_dir)[2]
    themes = rows.select("product_id", "week_ending", F.explode("top_themes").alias("t")).select(
        "product_id", "week_ending", F.col("t.id").alias("theme_id")
    )
    said = rows.select("product_id", "week_ending", F.inline("quotes")).drop("date", "rating")
    ideas = rows.select("product_id", "week_ending", F.inline("actions"))
    quote = reports.first_per_theme(said, "review_id", "text")
    action = reports.first_per_theme(ideas, "title").withColumnRenamed("title", "action")
    return themes.join(quote, key, "left").join(action, key, "left")


# Quotes are tampered with per product: a cut text stays verbatim, an appended word does not.
_TAMPER = """,
tampered AS (
  SELECT product_id, week_ending, theme_id, review_id, rank AS pos,
         CASE rank WHEN 1 THEN substr(p.text, 3, 20) WHEN 2 THEN p.text || ' indeed' ELSE p.text END AS quote
  FROM conv_picks p JOIN conv_top USING (product_id, week_ending, theme_id))"""


def _tampered(spark, sf_dir):
    reviews, built, rows = conversation_reports(spark, sf_dir)
    changed = F.transform(
        "quotes",
        lambda q: q.withField(
            "text",
            F.when(q["pos"] == 1, F.substring(q["text"], 3, 20))
            .when(q["pos"] == 2, F.concat(q["text"], F.lit(" indeed")))
            .otherwise(q["text"]),
        ),
    )
    return reviews, built, rows.withColumn("quotes", changed)


@query(f"""WITH {REPORTS}{_TAMPER}
SELECT t.product_id, t.week_ending, t.pos, t.review_id,
       NOT coalesce(contains(m.title || chr(10) || m.text, t.quote), false) AS not_verbatim,
       NOT coalesce(m.date BETWEEN w.reporting_from AND w.reporting_to - 3, true) AS out_of_window
FROM tampered t JOIN conv_win w USING (product_id, week_ending)
LEFT JOIN conv m ON m.product_id = t.product_id AND m.id = t.review_id""")
def quote_provenance(spark, sf_dir):
    """Provenance of tampered quotes, against a window that ends three days early."""
    reviews, _, rows = _tampered(spark, sf_dir)
    window = F.struct(
        F.col("reporting_window.from").alias("from"), F.date_sub("reporting_window.to", 3).alias("to")
    )
    return validation.quote_checks(rows.withColumn("reporting_window", window), reviews)


@query(f"""WITH {REPORTS}{_TAMPER}, bad AS (
  SELECT t.product_id, t.week_ending, bool_or(NOT contains(m.title || chr(10) || m.text, t.quote)) AS not_verbatim
  FROM tampered t JOIN conv m ON m.product_id = t.product_id AND m.id = t.review_id GROUP BY t.product_id, t.week_ending),
total AS (SELECT product_id, week_ending, count(*) AS n FROM conv_stats GROUP BY product_id, week_ending),
codes AS (
  SELECT r.product_id, r.week_ending, list_filter([
      CASE WHEN r.n_themes <> 3 THEN 'THEME_COUNT' END, CASE WHEN total.n > 4 THEN 'THEME_CAP' END,
      CASE WHEN r.n_quotes <> 3 THEN 'QUOTE_COUNT' END,
      CASE WHEN r.n_themes <> 2 OR r.product_id = 'user' THEN 'ACTION_COUNT' END, CASE WHEN bad.not_verbatim THEN 'QUOTE_NOT_VERBATIM' END,
      CASE WHEN r.product_id = 'system' THEN 'NON_PLAY_DATA' END], lambda c: c IS NOT NULL) AS failures
  FROM conv_reports r LEFT JOIN bad USING (product_id, week_ending) LEFT JOIN total USING (product_id, week_ending))
SELECT product_id, week_ending, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed,
       NOT list_contains(failures, 'NON_PLAY_DATA') AS fixable,
       CASE WHEN len(failures) = 0 THEN 'publish' WHEN list_contains(failures, 'NON_PLAY_DATA') THEN 'abort' ELSE 'retry_generate' END AS route
FROM codes""")
def report_validation(spark, sf_dir):
    """Codes of tampered reports: a stray action, a foreign store and tighter limits."""
    cfg = replace(
        DEFAULT,
        themes=replace(DEFAULT.themes, max_total=4),
        note=replace(DEFAULT.note, max_words=100_000, action_count=2),
    )
    reviews, built, rows = _tampered(spark, sf_dir)
    stray = F.transform("actions", lambda a: a.withField("theme_id", F.lit("nowhere")))
    rows = rows.withColumn("actions", F.when(F.col("product_id") == "user", stray).otherwise(F.col("actions")))
    mixed = reviews.withColumn(
        "store", F.when(F.col("product_id") == "system", F.lit("app_store")).otherwise(F.col("store"))
    )
    checked = validation.validate_reports(rows, mixed, built.stats, cfg, md=F.lit("nothing personal"))
    step = validation.route(F.col("passed"), F.col("fixable"), F.lit(1), 3)
    return checked.select(
        "product_id",
        "week_ending",
        F.array_join("failures", ",").alias("failures"),
        "passed",
        "fixable",
        step.alias("route"),
    )


# Five weeks of reports at once, tampered with by product and week so that each code occurs: a review
# quoted from before its window, an appended word, long actions, a stray one, a missing quote or
# theme, a mail address, another store in one corpus, and a tighter cap.
_WEEKLY_REPORTS = WEEKLY + f""",
wk_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, week_ending ORDER BY count_week DESC, avg_rating_week ASC NULLS LAST, theme_id) AS rank
  FROM wk_stats),
{top_sql('wk_ranked', 'wk_all_top')},
wk_top AS (
  SELECT * FROM wk_all_top WHERE NOT (product_id = 'en' AND week_ending = DATE '2024-01-28' AND rank = 3)),
wk_said AS (
  SELECT c.product_id, c.week_ending, p.merged AS theme_id, c.id, c.date >= w.reporting_from AS inside
  FROM wk_corpus c JOIN wk_cap p USING (product_id, week_ending, theme_id) JOIN wk_win w USING (product_id, week_ending)),
wk_picks AS (
  SELECT t.product_id, t.week_ending, t.theme_id, t.rank, min(s.id) AS id, bool_or(s.inside) AS inside
  FROM wk_top t JOIN wk_said s USING (product_id, week_ending, theme_id)
  WHERE s.inside = NOT (t.product_id = 'de' AND t.rank = 1)
    AND NOT (t.product_id = 'en' AND t.week_ending = DATE '2024-02-11' AND t.rank = 2)
  GROUP BY t.product_id, t.week_ending, t.theme_id, t.rank),
wk_said_count AS (SELECT product_id, week_ending, count(*) AS n, bool_or(NOT inside) AS early, bool_or(product_id = 'fr' AND rank = 2) AS changed
  FROM wk_picks GROUP BY product_id, week_ending),
wk_top_count AS (SELECT product_id, week_ending, count(*) AS n FROM wk_top GROUP BY product_id, week_ending),
wk_total AS (SELECT product_id, week_ending, count(*) AS n FROM wk_stats GROUP BY product_id, week_ending),
wk_foreign AS (SELECT DISTINCT week_ending FROM wk_corpus WHERE product_id = 'fr' AND date = DATE '2024-01-03'),
wk_sized AS (
  SELECT w.product_id, w.week_ending, coalesce(t.n, 0) AS themes, coalesce(q.n, 0) AS quotes, coalesce(q.early, false) AS early,
         coalesce(q.changed, false) AS changed, coalesce(a.n, 0) AS total,
         3 * coalesce(q.n, 0) + CASE WHEN q.changed THEN 1 ELSE 0 END + coalesce(t.n, 0) * (CASE WHEN w.product_id = 'es' THEN 8 ELSE 2 END) AS words
  FROM wk_win w LEFT JOIN wk_top_count t USING (product_id, week_ending) LEFT JOIN wk_said_count q USING (product_id, week_ending)
  LEFT JOIN wk_total a USING (product_id, week_ending)),
wk_codes AS (
  SELECT product_id, week_ending, words, list_filter([
      CASE WHEN words > 20 THEN 'WORD_LIMIT' END, CASE WHEN themes <> 3 THEN 'THEME_COUNT' END, CASE WHEN total > 4 THEN 'THEME_CAP' END,
      CASE WHEN quotes <> 3 THEN 'QUOTE_COUNT' END,
      CASE WHEN themes <> 3 OR product_id = 'es' AND week_ending = DATE '2024-02-18' AND themes > 0 THEN 'ACTION_COUNT' END,
      CASE WHEN changed THEN 'QUOTE_NOT_VERBATIM' END, CASE WHEN early THEN 'QUOTE_OUT_OF_WINDOW' END,
      CASE WHEN product_id = 'fr' AND week_ending IN (SELECT week_ending FROM wk_foreign) THEN 'NON_PLAY_DATA' END,
      CASE WHEN product_id = 'fr' AND week_ending = DATE '2024-02-25' THEN 'PII_DETECTED' END], lambda c: c IS NOT NULL) AS failures
  FROM wk_sized)"""


def weekly_reports(spark, sf_dir):
    """Tampered reports of five weeks with their reviews, themes and text to scan."""
    reviews, windows, built = weekly_build(spark, sf_dir)
    key = ["product_id", "week_ending"]
    reviews = reviews.withColumn("text", F.concat(F.lit("alpha beta "), "id")).withColumn(
        "store", F.when(F.expr("product_id = 'fr' AND date = DATE '2024-01-03'"), "app_store").otherwise(F.col("store"))
    )
    top = built.top.filter("NOT (product_id = 'en' AND week_ending = DATE '2024-01-28' AND rank = 3)")
    top = cut_lineage(top)
    said = week_members(built.members, windows, built.mapping).select(*key, "theme_id", "id", "date")
    said = said.join(windows.select(*key, "reporting_from"), key).join(top.select(*key, "theme_id", F.col("rank").alias("pos")), [*key, "theme_id"])
    said = said.filter("(date >= reporting_from) = (NOT (product_id = 'de' AND pos = 1))").filter(
        "NOT (product_id = 'en' AND week_ending = DATE '2024-02-11' AND pos = 2)"
    )
    picks = said.groupBy(*key, "theme_id", "pos").agg(F.min("id").alias("review_id"))
    detail = F.when(F.col("product_id") == "es", "one two three four five six").otherwise("")
    stray = F.expr("product_id = 'es' AND week_ending = DATE '2024-02-18' AND rank = 1")
    actions = top.select(
        *key,
        F.col("rank").alias("pos"),
        F.concat(F.lit("Improve "), "label").alias("title"),
        detail.alias("detail"),
        F.when(stray, "nowhere").otherwise(F.col("theme_id")).alias("theme_id"),
    )
    summaries = spark.createDataFrame([], "product_id string, week_ending date, theme_id string, summary string, pos int")
    rows = reports.assemble_reports(top, summaries, cut_lineage(picks), actions, reviews, windows)
    changed = F.transform(
        "quotes",
        lambda q: q.withField(
            "text",
            F.when((F.col("product_id") == "fr") & (q["pos"] == 2), F.concat(q["text"], F.lit(" indeed"))).otherwise(q["text"]),
        ),
    )
    rows = rows.withColumn("quotes", changed)
    mail = F.expr("product_id = 'fr' AND week_ending = DATE '2024-02-25'")
    rows = rows.withColumn("md", F.when(mail, "write to someone@mail.example").otherwise("nothing personal"))
    return reviews, built, cut_lineage(rows)


@query(f"""WITH {_WEEKLY_REPORTS}
SELECT product_id, week_ending, words AS body_word_count, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed,
       NOT (list_contains(failures, 'NON_PLAY_DATA') OR list_contains(failures, 'PII_DETECTED')) AS fixable FROM wk_codes""")
def weekly_validation(spark, sf_dir):
    """All nine failure codes, over twenty reports of five weeks."""
    cfg = replace(
        DEFAULT, themes=replace(DEFAULT.themes, max_total=4), note=replace(DEFAULT.note, max_words=20, action_count=3, quote_count=3)
    )
    reviews, built, rows = weekly_reports(spark, sf_dir)
    checked = validation.validate_reports(rows, reviews, built.stats, cfg, md=F.col("md"))
    return checked.select(
        "product_id", "week_ending", F.col("body_word_count").cast("bigint").alias("body_word_count"),
        F.array_join("failures", ",").alias("failures"), "passed", "fixable",
    )


@query(f"""WITH {_WEEKLY_REPORTS}
SELECT product_id, week_ending, rank AS pos, id AS review_id, product_id = 'fr' AND rank = 2 AS not_verbatim, NOT inside AS out_of_window FROM wk_picks""")
def weekly_provenance(spark, sf_dir):
    """Provenance of the quotes of five weeks."""
    reviews, _, rows = weekly_reports(spark, sf_dir)
    return validation.quote_checks(rows, reviews)


@query(f"""WITH {REPORTS}
SELECT product_id, week_ending, n_themes <> 3 OR product_id = 'user' AS stray FROM conv_reports""")
def action_membership(spark, sf_dir):
    """Reports with the wrong number of actions or one on a theme that is not on top."""
    rows = conversation_reports(spark, sf_dir)[2]
    moved = F.transform(
        "actions",
        lambda a: a.withField(
            "theme_id",
            F.when(F.col("product_id") == "user", F.concat(a["theme_id"], F.lit("_x"))).otherwise(a["theme_id"]),
        ),
    )
    stray = validation.stray_action(moved, F.col("top_themes"))
    return rows.select("product_id", "week_ending", ((F.size("actions") != 3) | stray).alias("stray"))


@query()
def validated_reports(spark, sf_dir):
    """Reports that pass every check, personal data included."""
    reviews, built, rows = conversation_reports(spark, sf_dir)
    checked = validation.validate_reports(rows, reviews, built.stats)
    return publishable(rows, checked).select("product_id", "week_ending", "body_word_count")


@query("""
SELECT report_no, string_agg(codes, ' | ' ORDER BY attempt) AS history FROM (
  SELECT event_id // 3 AS report_no, event_id % 3 AS attempt,
         CASE event_type WHEN 'error' THEN 'WORD_LIMIT,THEME_CAP' WHEN 'view' THEN '' ELSE upper(event_type) END AS codes
  FROM events) GROUP BY report_no""")
def failure_history(spark, sf_dir):
    """Three attempts per report."""
    attempts = table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id DIV 3 AS STRING) AS product_id",
        "DATE '2024-01-28' AS week_ending",
        "event_id % 3 AS attempt",
        """CASE event_type WHEN 'error' THEN array('WORD_LIMIT', 'THEME_CAP') WHEN 'view' THEN CAST(array() AS ARRAY<STRING>)
           ELSE array(upper(event_type)) END AS failures""",
    )
    joined = F.array_join(F.transform("failure_history", lambda codes: F.array_join(codes, ",")), " | ")
    return validation.failure_history(attempts).select(
        F.col("product_id").cast("bigint").alias("report_no"), joined.alias("history")
    )


@query("""
SELECT event_id, CASE WHEN passed THEN 'publish' WHEN NOT fixable OR attempts >= 3 THEN 'abort' ELSE 'retry_generate' END AS route,
       CASE WHEN passed THEN 'passed' WHEN NOT fixable THEN 'aborted_non_fixable' WHEN attempts >= 3 THEN 'aborted_attempts_exhausted' ELSE 'pending' END AS status,
       CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 2 THEN 'empty_corpus' WHEN 3 THEN 'validate_abort' WHEN 4 THEN 'publish_failed' WHEN 5 THEN 'lock_busy' ELSE 'failed' END AS run
FROM (SELECT event_id, event_type = 'view' AS passed, event_type <> 'error' AS fixable, 1 + user_id % 4 AS attempts FROM events)""")
def status_routes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type = 'view' AS passed", "event_type <> 'error' AS fixable", "1 + user_id % 4 AS attempts"
    )
    state = (F.col("passed"), F.col("fixable"), F.col("attempts"), 3)
    return rows.select(
        "event_id",
        validation.route(*state).alias("route"),
        validation.final_status(*state).alias("status"),
        validation.run_status(F.col("event_id") % 7).alias("run"),
    )


@query()
def run_summaries(spark, sf_dir):
    """Ingest, redaction, themes and validation of the conversations in one row per report."""
    reviews, built, rows = conversation_reports(spark, sf_dir)
    checked = validation.validate_reports(rows, reviews, built.stats)
    raw = reviews.selectExpr(
        "product_id", "text", "CAST(date AS STRING) AS date_raw", "title", "CAST(rating AS STRING) AS rating_raw",
        "app_version", "'conversations' AS source_file", "conv_id * 1000 + turn AS row_no",
    )
    report = ingest_reviews(raw).report.drop("week_ending")
    weeks = rows.select("product_id", "week_ending")
    return run_summary(
        weeks.join(report, "product_id"), redaction_report(redact_reviews(reviews)), built.stats, checked
    )

