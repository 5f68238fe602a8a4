"""Queries over themes: reconciliation, caps, statistics, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, Config, ThemeConfig
from reviewmill.functions.text import slug, theme_label, title_label
from reviewmill.operators import themes
from reviewmill.operators.clean import anchor_dates
from reviewmill.operators.windows import compute_windows, daily_rollup
from reviewmill.plans.queries.inputs import (
    CONV,
    CONV_MEMBERS,
    CONV_STATS,
    EV,
    EV_ANCHOR,
    EVENT_LABELS,
    EV_STATS,
    EVENT_CONFIG,
    conversation_assignments,
    conversation_reviews,
    event_reviews,
    mean_sql,
    stats_sql,
    table,
    top_sql,
    windows_sql,
)
from reviewmill.plans.queries.registry import query
from reviewmill.plans.weekly import build_themes
from reviewmill.scale import cut_lineage

STAT_COLUMNS = (
    "product_id, week_ending, theme_id, label, count_corpus, count_week, avg_rating_week, baseline_weekly, trend"
)


def event_members(spark, sf_dir):
    reviews = event_reviews(spark, sf_dir)
    return reviews.withColumn("theme_id", themes.valid_theme(F.col("theme_raw"), EVENT_CONFIG.themes))


def event_stats(spark, sf_dir, weeks_back: int = 0):
    """Ranked statistics of the newest weeks, all from one rollup of the reviews."""
    daily = cut_lineage(daily_rollup(event_members(spark, sf_dir), themes.THEME_KEY))
    weeks = daily.groupBy("product_id").agg(F.max("date").alias("newest")).select(
        "product_id",
        F.explode(
            F.sequence("newest", F.date_sub("newest", 7 * weeks_back), F.expr("interval -7 days"))
        ).alias("week_ending"),
    )
    windows = compute_windows(daily, weeks, EVENT_CONFIG.windows)
    return themes.rank_themes(themes.theme_stats(daily, windows, EVENT_CONFIG.windows, EVENT_CONFIG.themes))


def conversation_build(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    daily = cut_lineage(daily_rollup(reviews))
    windows = cut_lineage(compute_windows(daily, anchor_dates(daily)))
    return reviews, windows, build_themes(reviews, conversation_assignments(reviews), windows)


@query(f"WITH {CONV} SELECT product_id, id, theme_id, confidence FROM conv_recon")
def reconciled_assignments(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    return themes.reconcile(reviews, conversation_assignments(reviews)).select(
        "product_id", "id", "theme_id", "confidence"
    )


@query(f"""WITH {CONV} SELECT product_id, id, theme_id, confidence FROM conv_ranked WHERE from_end = 1""")
def last_assignments(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    return themes.last_assignments(conversation_assignments(reviews)).drop("first_pos")


@query(f"""WITH {CONV}, valid AS (
  SELECT unnest(['onboarding', 'kyc', 'payments', 'trading', 'withdrawals', 'other']) AS theme_id)
SELECT v.theme_id, count(r.id) AS n FROM valid v LEFT JOIN conv_recon r USING (theme_id) GROUP BY v.theme_id""")
def seed_dimension(spark, sf_dir):
    """Seeds and ``other`` with the reviews each holds, empty ones included."""
    ids = [*DEFAULT.themes.seed_ids, "other"]
    valid = spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("theme_id"))
    reviews = conversation_reviews(spark, sf_dir)
    sizes = themes.reconcile(reviews, conversation_assignments(reviews)).groupBy("theme_id").agg(
        F.count("id").alias("n")
    )
    return valid.join(sizes, "theme_id", "left").select("theme_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT event_id, CASE event_type WHEN 'signup' THEN 'Sign up & login' WHEN 'error' THEN 'Errors & crashes'
         WHEN 'click' THEN 'Navigation' WHEN 'view' THEN 'Screens' ELSE 'Late Purchase' END AS label,
       'late_' || event_type AS slug, 'Late ' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS title,
       '3D ' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) || '-Issue ' || CAST(user_id AS VARCHAR) || 'Fa' AS mixed_title
FROM events""")
def theme_labels(spark, sf_dir):
    late = F.concat(F.lit(" Late "), F.upper("event_type"), F.lit(" "))
    rows = table(spark, sf_dir, "events").withColumn("slug", slug(late))
    theme = F.when(F.col("event_type") == "purchase", F.col("slug")).otherwise(F.col("event_type"))
    return rows.select(
        "event_id",
        theme_label(theme, EVENT_CONFIG.themes.seeds).alias("label"),
        "slug",
        title_label(F.col("slug")).alias("title"),
        title_label(F.concat(F.lit("3d_"), "event_type", F.lit("-issue_"), "user_id", F.lit("fa"))).alias("mixed_title"),
    )


@query(f"""WITH {CONV}
SELECT product_id, count(*) FILTER (WHERE theme_id = 'other') AS other_count, count(*) AS total,
       count(DISTINCT theme_id) AS themes, count(*) FILTER (WHERE theme_id = 'other') / count(*) AS share,
       count(*) FILTER (WHERE theme_id = 'other') / count(*) > 0.20 AND count(DISTINCT theme_id) < 5 AS split
FROM conv_recon GROUP BY product_id""")
def other_share(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    return themes.other_share(themes.reconcile(reviews, conversation_assignments(reviews)))


@query(f"""WITH {CONV} SELECT product_id, id, sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date, id) AS sample_no FROM conv_recon WHERE theme_id = 'other')
WHERE sample_no <= 50""")
def split_sample(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    members = themes.reconcile(reviews, conversation_assignments(reviews))
    return themes.split_sample(members).select("product_id", "id", "sample_no")


@query(f"""WITH {CONV}
SELECT r.product_id, r.id,
       CASE WHEN r.product_id <> 'system' AND (c.conv_id + c.turn) % 7 >= 5 THEN 'app_speed' ELSE r.theme_id END AS theme_id,
       CASE WHEN r.product_id <> 'system' AND (c.conv_id + c.turn) % 7 >= 5 THEN 'Speed' END AS new_label
FROM conv_recon r JOIN conv c USING (product_id, id)""")
def split_other(spark, sf_dir):
    """A new theme proposed for two products, an already existing one for the third."""
    reviews = conversation_reviews(spark, sf_dir)
    members = themes.reconcile(reviews, conversation_assignments(reviews))
    proposals = reviews.select("product_id").distinct().select(
        "product_id",
        F.expr("CASE product_id WHEN 'system' THEN 'KYC' ELSE ' App Speed ' END").alias("new_theme_id"),
        F.lit("Speed").alias("new_theme_label"),
    )
    moves = reviews.filter(F.col("theme_raw").isin("mystery", "unlisted_theme")).select(
        "product_id",
        F.col("id").alias("review_id"),
        F.expr("CASE product_id WHEN 'system' THEN 'kyc' ELSE 'app_speed' END").alias("theme_id"),
    )
    return themes.split_other(members, proposals, moves).select("product_id", "id", "theme_id", "new_label")


@query(f"WITH {CONV_MEMBERS} SELECT product_id, id, theme_id FROM conv_members")
def merge_to_cap(spark, sf_dir):
    reviews = conversation_reviews(spark, sf_dir)
    members = themes.reconcile(reviews, conversation_assignments(reviews))
    return themes.merge_to_cap(members).select("product_id", "id", "theme_id")


@query(f"""WITH {EV}, placed AS (
  SELECT product_id, theme_id, id, row_number() OVER (PARTITION BY product_id, theme_id ORDER BY date, id) - 1 AS pos FROM ev)
SELECT product_id, theme_id, pos // 100 AS chunk_no, string_agg(id, ',' ORDER BY pos) AS review_ids
FROM placed GROUP BY product_id, theme_id, pos // 100""")
def theme_member_lists(spark, sf_dir):
    lists = themes.member_lists(event_members(spark, sf_dir), chunk=100)
    return lists.withColumn("review_ids", F.array_join("review_ids", ","))


@query(f"""WITH {EV} SELECT product_id, theme_id, date, count(*) AS n, count(rating) AS rated,
       CAST(coalesce(sum(rating), 0) AS BIGINT) AS rating_sum FROM ev GROUP BY product_id, theme_id, date""")
def theme_daily_rollup(spark, sf_dir):
    return daily_rollup(event_members(spark, sf_dir), themes.THEME_KEY)


@query(f"WITH {EV_STATS} SELECT {STAT_COLUMNS} FROM ev_stats")
def theme_statistics(spark, sf_dir):
    return event_stats(spark, sf_dir).drop("rank")


@query(f"""WITH {EV}, {EV_ANCHOR}, ev_weeks AS (
  SELECT product_id, week_ending - 7 * k AS week_ending FROM ev_week, (SELECT unnest([0, 1, 2, 3]) AS k)),
{windows_sql('ev', 'ev_weeks', 'ev_win')}, {stats_sql('ev', 'ev_win', 'ev_stats', EVENT_LABELS)}
SELECT {STAT_COLUMNS}, rank FROM ev_stats""")
def weekly_backfill(spark, sf_dir):
    """Four weeks of statistics and ranks for every product in one plan."""
    return event_stats(spark, sf_dir, weeks_back=3)


@query(f"WITH {EV_STATS} SELECT product_id, week_ending, theme_id, rank FROM ev_stats")
def theme_ranking(spark, sf_dir):
    return event_stats(spark, sf_dir).select("product_id", "week_ending", "theme_id", "rank")


@query(f"WITH {EV_STATS}, {top_sql('ev_stats', 'ev_top')} SELECT {STAT_COLUMNS}, rank FROM ev_top")
def top_themes(spark, sf_dir):
    return themes.top_themes(event_stats(spark, sf_dir))


@query(f"WITH {CONV_STATS} SELECT {STAT_COLUMNS}, rank FROM conv_stats")
def built_themes(spark, sf_dir):
    """Assignments to ranked themes: last wins, unknown to other, merged to five, statistics."""
    return conversation_build(spark, sf_dir)[2].stats


# Documents as reviews of eight weeks: nine themes, of which each week sees other ones, so the cap
# folds different themes in every week and product.
WEEKLY_SEEDS = tuple((f"t{i}", f"T{i}") for i in range(9))
WEEKLY_CONFIG = Config(themes=ThemeConfig(seeds=WEEKLY_SEEDS))
WEEKLY = f"""
wk AS (
  SELECT lang AS product_id, substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12) AS id, DATE '2024-01-01' + CAST((doc_id * 11) % 56 AS INTEGER) AS date,
         CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 1 + n_chars % 5 END AS rating,
         CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE 't' || CAST((doc_id % 6 + ((doc_id * 11) % 56) // 7) % 9 AS VARCHAR) END AS theme_id,
         doc_id AS seen
  FROM documents),
wk_weeks AS (
  SELECT product_id, DATE '2024-02-25' - 7 * k AS week_ending FROM (SELECT DISTINCT product_id FROM wk), (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
{windows_sql('wk', 'wk_weeks', 'wk_win')},
wk_corpus AS (
  SELECT w.week_ending, m.* FROM wk_win w JOIN wk m ON m.product_id = w.product_id AND m.date BETWEEN w.corpus_from AND w.corpus_to),
wk_sizes AS (
  SELECT product_id, week_ending, theme_id, count(*) AS size, min(seen) AS seen FROM wk_corpus GROUP BY product_id, week_ending, theme_id),
wk_cap AS (
  SELECT product_id, week_ending, theme_id,
         CASE WHEN count(*) OVER (PARTITION BY product_id, week_ending) > 5 AND row_number() OVER (
                PARTITION BY product_id, week_ending ORDER BY theme_id = 'other', size DESC, seen DESC) > 4
              THEN 'other' ELSE theme_id END AS merged
  FROM wk_sizes),
wk_sums AS (
  SELECT c.product_id, c.week_ending, merged AS theme_id, count(*) AS count_corpus,
         count(*) FILTER (WHERE c.date >= w.reporting_from) AS count_week,
         count(rating) FILTER (WHERE c.date >= w.reporting_from) AS rated, sum(rating) FILTER (WHERE c.date >= w.reporting_from) AS total
  FROM wk_corpus c JOIN wk_cap USING (product_id, week_ending, theme_id) JOIN wk_win w USING (product_id, week_ending)
  GROUP BY c.product_id, c.week_ending, merged),
wk_stats AS (
  SELECT product_id, week_ending, theme_id, CASE theme_id WHEN 'other' THEN 'Unclassified' ELSE upper(theme_id) END AS label, count_corpus, count_week,
         {mean_sql('total', 'rated')} AS avg_rating_week, CAST(printf('%.2f', count_corpus / 4) AS DOUBLE) AS baseline_weekly
  FROM wk_sums)"""


def weekly_reviews(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS product_id",
        "substring(sha1(CAST(doc_id AS STRING)), 1, 12) AS id",
        "'play_store' AS store",
        "date_add(DATE '2024-01-01', CAST((doc_id * 11) % 56 AS INT)) AS date",
        "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(1 + n_chars % 5 AS INT) END AS rating",
        "'' AS title",
        "text",
        "CAST(NULL AS STRING) AS app_version",
        "CASE WHEN doc_id % 17 = 0 THEN 'other' ELSE concat('t', (doc_id % 6 + (doc_id * 11) % 56 DIV 7) % 9) END AS theme_raw",
        "doc_id",
    )


def weekly_build(spark, sf_dir):
    reviews = weekly_reviews(spark, sf_dir)
    assignments = reviews.selectExpr(
        "product_id", "id AS review_id", "theme_raw AS theme_id", "CAST(1 AS DOUBLE) AS confidence",
        "doc_id AS batch_no", "0 AS pos",
    )
    daily = cut_lineage(daily_rollup(reviews))
    weeks = daily.select("product_id").distinct().select(
        "product_id",
        F.explode(F.sequence(F.lit("2024-02-25").cast("date"), F.lit("2024-01-28").cast("date"), F.expr("interval -7 days"))).alias("week_ending"),
    )
    windows = cut_lineage(compute_windows(daily, weeks, WEEKLY_CONFIG.windows))
    return reviews, windows, build_themes(reviews, assignments, windows, WEEKLY_CONFIG)


@query(f"""WITH {WEEKLY} SELECT product_id, week_ending, theme_id, label, count_corpus, count_week, avg_rating_week, baseline_weekly FROM wk_stats""")
def weekly_themes(spark, sf_dir):
    """Five weeks built at once, each capped by the themes of its own corpus."""
    return weekly_build(spark, sf_dir)[2].stats.drop("rank", "trend")


@query(f"""WITH {WEEKLY} SELECT product_id, week_ending, theme_id, merged AS merged_id FROM wk_cap""")
def weekly_cap(spark, sf_dir):
    return weekly_build(spark, sf_dir)[2].mapping


@query(f"""WITH {WEEKLY}, sized AS (
  SELECT product_id, week_ending, count(*) FILTER (WHERE theme_id = 'other') AS other_count, count(*) AS total, count(DISTINCT theme_id) AS themes
  FROM wk_corpus GROUP BY product_id, week_ending)
SELECT *, other_count / total AS share, other_count / total > 0.20 AND themes < 5 AS split FROM sized""")
def weekly_other_share(spark, sf_dir):
    _, windows, built = weekly_build(spark, sf_dir)
    return themes.other_share(themes.week_members(built.members, windows))


@query(f"""WITH {WEEKLY}, placed AS (
  SELECT product_id, week_ending, merged AS theme_id, id,
         row_number() OVER (PARTITION BY product_id, week_ending, merged ORDER BY date, id) - 1 AS pos
  FROM wk_corpus JOIN wk_cap USING (product_id, week_ending, theme_id))
SELECT product_id, week_ending, theme_id, pos // 100 AS chunk_no, string_agg(id, ',' ORDER BY pos) AS review_ids
FROM placed GROUP BY product_id, week_ending, theme_id, pos // 100""")
def weekly_member_lists(spark, sf_dir):
    _, windows, built = weekly_build(spark, sf_dir)
    members = themes.week_members(built.members, windows, built.mapping)
    lists = themes.member_lists(members.select("product_id", "week_ending", "theme_id", "date", "id"), chunk=100)
    return lists.withColumn("review_ids", F.array_join("review_ids", ","))


KEYWORDS = (
    ("onboarding", ("ein", "est", "the")),
    ("kyc", ("und", "les", "and")),
    ("payments", ("der", "que", "with")),
    ("trading", ("die", "des", "for")),
)


def _hits(words: tuple[str, ...]) -> str:
    alternatives = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(tokens, lambda t: t IN ({alternatives})))"


@query(f"""
WITH tokens AS (
  SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS tokens FROM conversations),
hits AS (SELECT conv_id, turn, {', '.join(f"{_hits(words)} AS h{i}" for i, (_, words) in enumerate(KEYWORDS))} FROM tokens)
SELECT conv_id, turn, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN 'other' WHEN h0 = greatest(h0, h1, h2, h3) THEN 'onboarding'
  WHEN h1 = greatest(h0, h1, h2, h3) THEN 'kyc' WHEN h2 = greatest(h0, h1, h2, h3) THEN 'payments' ELSE 'trading' END AS theme_id
FROM hits""")
def keyword_themes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", themes.keyword_theme(F.col("text"), KEYWORDS).alias("theme_id"))


@query("""
WITH texts AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM conversations),
phrases AS (
  SELECT 'b' || CAST(item_id % 7 AS VARCHAR) AS theme_id, words, min(item_id % 7) AS place
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')[1:1 + item_id % 2] AS words FROM benchmark)
  WHERE len(words) > 0 GROUP BY ALL),
placed AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM texts),
hits AS (
  SELECT conv_id, turn, theme_id, min(place) AS place, count(*) AS hits
  FROM placed JOIN phrases ON t[i] = words[1] AND t[i:i + len(words) - 1] = words GROUP BY conv_id, turn, theme_id),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, place, theme_id) AS n FROM hits)
SELECT t.conv_id, t.turn, coalesce(b.theme_id, 'other') AS theme_id, coalesce(b.hits, 0) AS hits
FROM texts t LEFT JOIN best b ON b.conv_id = t.conv_id AND b.turn = t.turn AND b.n = 1""")
def keyword_table_themes(spark, sf_dir):
    """A phrase table as long as the benchmark: the first word or two of each item."""
    first = F.regexp_extract("text", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1)
    two = F.regexp_extract("text", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+(?:[^\p{L}\p{N}_]+[\p{L}\p{N}_]+)?)", 1)
    keywords = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id") % 7).alias("theme_id"),
        (F.col("item_id") % 7).alias("place"),
        F.when(F.col("item_id") % 2 == 0, first).otherwise(two).alias("phrase"),
    )
    return themes.keyword_table_themes(table(spark, sf_dir, "conversations"), keywords, ["conv_id", "turn"])
