"""Assign reviews to themes, keep the theme set small, and compute weekly theme statistics.

Membership is a table of (product_id, id, theme_id), never an array on a theme row, so a theme
may hold any share of the reviews.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, OTHER, ThemeConfig, WindowConfig
from reviewmill.functions.numbers import ratio_2dp
from reviewmill.functions.text import slug, theme_label, title_label
from reviewmill.operators.ordering import corpus_position
from reviewmill.operators.windows import daily_rollup, in_window, spread_weeks
from reviewmill.scale import attach_small, cut_lineage

THEME_KEY = ("product_id", "theme_id")


def week_key(rows: DataFrame) -> list[str]:
    """What themes are told apart by: the product, and the week where rows belong to one.

    A week's themes are those of its own corpus, so anything built for several weeks at once
    carries ``week_ending`` (see ``in_window`` and ``rollup_by_week``).
    """
    return ["product_id", "week_ending"] if "week_ending" in rows.columns else ["product_id"]


def valid_theme(theme_id: Column, themes: ThemeConfig = DEFAULT.themes) -> Column:
    """The id itself if it is a seed or ``other``, else ``other``."""
    return F.when(theme_id.isin(*themes.seed_ids, OTHER), theme_id).otherwise(F.lit(OTHER))


def last_assignments(assignments: DataFrame) -> DataFrame:
    """Per review the last assignment, and the position at which the review was first seen."""
    at = F.struct("batch_no", "pos")
    return (
        assignments.groupBy("product_id", "review_id")
        .agg(
            F.max_by(F.struct("theme_id", "confidence"), at).alias("_last"),
            F.min(at).alias("first_pos"),
        )
        .select(
            "product_id",
            F.col("review_id").alias("id"),
            F.col("_last.theme_id").alias("theme_id"),
            F.col("_last.confidence").alias("confidence"),
            "first_pos",
        )
    )


def reconcile(
    reviews: DataFrame, assignments: DataFrame, themes: ThemeConfig = DEFAULT.themes
) -> DataFrame:
    """Every review with exactly one theme: its last assignment, or ``other``.

    Assignments of ids that are not reviews have no row to attach to and are left out.
    """
    joined = reviews.join(last_assignments(assignments), ["product_id", "id"], "left")
    return joined.withColumns(
        {
            "theme_id": valid_theme(F.coalesce(F.col("theme_id"), F.lit(OTHER)), themes),
            "confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
        }
    )


def other_share(members: DataFrame, themes: ThemeConfig = DEFAULT.themes) -> DataFrame:
    """Per product (and week) the share of ``other``, the number of non-empty themes and the split trigger."""
    sizes = members.groupBy(*week_key(members), "theme_id").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.groupBy(*week_key(members)).agg(
        F.coalesce(F.sum(F.when(F.col("theme_id") == OTHER, F.col("n"))), F.lit(0)).alias("other_count"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("themes"),
    )
    share = F.col("other_count") / F.col("total")
    return out.withColumn("share", share).withColumn(
        "split", (share > themes.split_share) & (F.col("themes") < themes.max_total)
    )


def split_sample(members: DataFrame, n: int = DEFAULT.themes.split_sample) -> DataFrame:
    """The first ``n`` reviews of ``other`` in corpus order: what a split proposal gets to see."""
    order = Window.partitionBy(*week_key(members)).orderBy("date", "id")
    return (
        members.filter(F.col("theme_id") == OTHER)
        .withColumn("sample_no", F.row_number().over(order))
        .filter(F.col("sample_no") <= n)
    )


def split_other(members: DataFrame, proposals: DataFrame, reassignments: DataFrame) -> DataFrame:
    """One split pass: move the named reviews to a proposed new theme.

    ``proposals`` has one (product_id, new_theme_id, new_theme_label) per product that may
    split; ``reassignments`` has (product_id, review_id, theme_id). Where members belong to
    weeks, both may name a ``week_ending`` and else hold for all of them. A blank or existing new
    id is ignored. Rows move from whatever theme they are in, not only from ``other``. Adds
    ``new_label`` on moved rows.
    """
    key = week_key(members)
    existing = members.groupBy(*key, "theme_id").agg(F.lit(True).alias("_exists"))
    if week_key(proposals) != key:
        proposals = proposals.join(members.select(*key).distinct(), "product_id")
    named = proposals.select(
        *key, slug(F.col("new_theme_id")).alias("theme_id"), "new_theme_label"
    ).filter(F.length("theme_id") > 0)
    fresh = named.join(existing, [*key, "theme_id"], "left_anti").select(
        *key,
        "theme_id",
        F.coalesce(F.nullif(F.col("new_theme_label"), F.lit("")), title_label(F.col("theme_id"))).alias(
            "new_label"
        ),
    )
    moves = (
        reassignments.join(fresh, [*week_key(reassignments), "theme_id"])
        .groupBy(*key, F.col("review_id").alias("id"))
        .agg(F.min(F.struct("theme_id", "new_label")).alias("_to"))
    )
    moved = members.join(moves, [*key, "id"], "left")
    return moved.withColumns(
        {
            "theme_id": F.coalesce(F.col("_to.theme_id"), F.col("theme_id")),
            "new_label": F.col("_to.new_label"),
        }
    ).drop("_to")


def member_rollup(members: DataFrame) -> DataFrame:
    """Daily rollup per theme, with the earliest assignment seen in each cell.

    The one pass over the members that both the theme cap and the statistics need.
    """
    unseen = F.struct(F.lit(1 << 62).alias("batch_no"), F.lit(0).alias("pos"))
    return daily_rollup(
        members, [*week_key(members), "theme_id"], seen=F.min(F.coalesce(F.col("first_pos"), unseen))
    )


def rollup_by_week(rollup: DataFrame, windows: DataFrame) -> DataFrame:
    """The rollup's rows for every week that counts their day, ``in_corpus`` or in its reporting window."""
    days = spread_weeks(
        windows.select("product_id", "week_ending", "corpus_from", "corpus_to", "reporting_from"),
        F.least("corpus_from", "reporting_from"),
        F.col("corpus_to"),
    )
    inside = F.col("date").between(F.col("corpus_from"), F.col("corpus_to"))
    joined = rollup.join(days, ["product_id", "date"]).withColumn("in_corpus", inside)
    return joined.select("week_ending", *rollup.columns, "in_corpus")


def cap_mapping(rollup: DataFrame, max_total: int = DEFAULT.themes.max_total) -> DataFrame:
    """(product_id[, week_ending], theme_id, merged_id): the smallest themes fold into ``other``.

    Equals folding one smallest theme at a time until ``max_total`` are left: the
    ``max_total - 1`` largest real themes stay. Among equal sizes the theme seen first is
    folded first. Sizes count the corpus of a week, whatever other weeks hold.
    """
    key = week_key(rollup)
    counted = F.when(F.col("in_corpus"), F.col("n")) if "in_corpus" in rollup.columns else F.col("n")
    sizes = rollup.groupBy(*key, "theme_id").agg(
        F.coalesce(F.sum(counted), F.lit(0)).alias("_size"), F.min("seen").alias("_seen")
    )
    group = Window.partitionBy(*key)
    largest = group.orderBy(F.col("theme_id") == OTHER, F.col("_size").desc(), F.col("_seen").desc())
    folded = (F.col("_themes") > max_total) & (F.col("_rank") > max_total - 1)
    return (
        sizes.withColumn("_themes", F.count(F.lit(1)).over(group))
        .withColumn("_rank", F.row_number().over(largest))
        .select(*key, "theme_id", F.when(folded, F.lit(OTHER)).otherwise(F.col("theme_id")).alias("merged_id"))
    )


def merge_to_cap(
    members: DataFrame, max_total: int = DEFAULT.themes.max_total, mapping: DataFrame | None = None
) -> DataFrame:
    """Members with at most ``max_total`` themes per product (and week)."""
    if mapping is None:
        mapping = cap_mapping(member_rollup(members), max_total)
    return (
        attach_small(members, mapping, [*week_key(members), "theme_id"])
        .withColumn("theme_id", F.col("merged_id"))
        .select(*members.columns)
    )


def merge_rollup(rollup: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same fold, on the daily rollup."""
    key = week_key(rollup)
    return (
        rollup.join(mapping, [*key, "theme_id"])
        .groupBy(*key, F.col("merged_id").alias("theme_id"), "date")
        .agg(F.sum("n").alias("n"), F.sum("rated").alias("rated"), F.sum("rating_sum").alias("rating_sum"))
    )


def week_members(members: DataFrame, windows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Members of every week's corpus, with that week's themes: what lists, samples and shares read."""
    if "week_ending" not in members.columns:
        members = in_window(members, windows, "corpus")
    return members if mapping is None else merge_to_cap(members, mapping=mapping)


def member_lists(members: DataFrame, chunk: int = 1000) -> DataFrame:
    """Review ids per theme in corpus order, as numbered arrays of at most ``chunk`` ids."""
    key = [*week_key(members), "theme_id"]
    return (
        corpus_position(members, key)
        .withColumn("chunk_no", F.floor(F.col("pos") / chunk))
        .groupBy(*key, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("_ids"))
        .select(*key, "chunk_no", F.col("_ids.id").alias("review_ids"))
    )


def trend(count_week: Column, baseline: Column) -> Column:
    """``rising`` from 1.25 times the baseline, ``falling`` up to 0.75 times, else ``steady``."""
    ratio = count_week / F.nullif(baseline, F.lit(0.0))
    return (
        F.when(baseline <= 0, F.when(count_week > 0, "rising").otherwise("steady"))
        .when(ratio >= 1.25, "rising")
        .when(ratio <= 0.75, "falling")
        .otherwise("steady")
    )


def theme_stats(
    daily: DataFrame,
    windows: DataFrame,
    cfg: WindowConfig = DEFAULT.windows,
    themes: ThemeConfig = DEFAULT.themes,
) -> DataFrame:
    """Statistics per (product, week, theme) from the daily rollup by theme, or by week and theme.

    The baseline is the whole corpus, current week included, over ``corpus_weeks``.
    """
    spans = spread_weeks(
        windows.select("product_id", "week_ending", "corpus_from", "corpus_to", "reporting_from", "reporting_to"),
        F.least("corpus_from", "reporting_from"),
        F.col("corpus_to"),
    )
    in_corpus = F.col("date").between(F.col("corpus_from"), F.col("corpus_to"))
    in_week = F.col("date").between(F.col("reporting_from"), F.col("reporting_to"))

    def total(col: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(col))), F.lit(0)).cast("bigint")

    summed = (
        daily.join(spans, [*week_key(daily), "date"])
        .groupBy("product_id", "week_ending", "theme_id")
        .agg(
            total("n", in_corpus).alias("count_corpus"),
            total("n", in_week).alias("count_week"),
            total("rated", in_week).alias("_rated"),
            total("rating_sum", in_week).alias("_sum"),
        )
    )
    baseline = (
        ratio_2dp(F.col("count_corpus"), F.lit(cfg.corpus_weeks)) if cfg.corpus_weeks > 0 else F.lit(0.0)
    )
    return (
        summed.withColumn("baseline_weekly", baseline)
        .select(
            "product_id",
            "week_ending",
            "theme_id",
            theme_label(F.col("theme_id"), themes.seeds).alias("label"),
            "count_corpus",
            "count_week",
            ratio_2dp(F.col("_sum"), F.col("_rated")).alias("avg_rating_week"),
            "baseline_weekly",
        )
        .withColumn("trend", trend(F.col("count_week"), F.col("baseline_weekly")))
    )


def rank_themes(stats: DataFrame) -> DataFrame:
    """Add ``rank`` per product and week: busiest first, then worst rated, then by id."""
    order = Window.partitionBy("product_id", "week_ending").orderBy(
        F.col("count_week").desc(), F.col("avg_rating_week").asc_nulls_last(), F.col("theme_id")
    )
    return stats.withColumn("rank", F.row_number().over(order))


def top_themes(ranked: DataFrame, n: int = DEFAULT.themes.highlight, exclude_other: bool = True) -> DataFrame:
    """The first ``n`` themes per product and week, without ``other`` where ``n`` real ones exist."""
    week = Window.partitionBy("product_id", "week_ending")
    real = (F.col("theme_id") != OTHER).cast("int")
    if not exclude_other:
        return ranked.filter(F.col("rank") <= n)
    out = ranked.withColumn("_real", F.sum(real).over(week)).withColumn(
        "_real_rank", F.sum(real).over(week.orderBy("rank"))
    )
    place = F.when(F.col("_real") >= n, F.when(real == 1, F.col("_real_rank"))).otherwise(F.col("rank"))
    return out.withColumn("rank", place.cast("int")).filter(F.col("rank") <= n).drop("_real", "_real_rank")


def keyword_theme(
    body: Column, keywords: Sequence[tuple[str, Sequence[str]]], default: str = OTHER
) -> Column:
    """The theme with most keyword hits, ties to the earlier entry, no hit to ``default``.

    ``keywords`` holds (theme id, plain words) in seed order. One expression per theme, so no
    join and no shuffle.
    """
    lowered = F.lower(body)
    scored = F.array(
        *(
            F.struct(
                F.regexp_count(
                    lowered, F.lit(r"(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])")
                ).alias("hits"),
                F.lit(-i).alias("place"),
                F.lit(theme_id).alias("theme_id"),
            )
            for i, (theme_id, words) in enumerate(keywords)
        )
    )
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["theme_id"]).otherwise(F.lit(default))


def keyword_table_themes(
    reviews: DataFrame, keywords: DataFrame, keys: Sequence[str] = ("product_id", "id"), text_col: str = "text", default: str = OTHER
) -> DataFrame:
    """``keys``, theme_id and hits: the theme whose phrases occur most often, for a table of any number of phrases.

    ``keywords`` has theme_id, phrase and place; equal hits go to the smaller place, then theme. Texts and
    phrases are runs of letters, digits and underscores in lower case, and every position where one of a
    theme's different phrases begins counts once for it. Tokens are joined with the phrases' first tokens, and
    the rest of longer phrases is compared in place, so the work follows the matches, not texts times
    phrases. Texts without a hit, or null, get ``default``; phrases without a token match nothing.
    """
    keys = list(keys)
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    phrases = (
        keywords.select("theme_id", "place", tokens(F.col("phrase")).alias("_words"))
        .filter(F.size("_words") > 0)
        .groupBy("theme_id", "_words")
        .agg(F.min("place").alias("place"))
        .withColumn("_token", F.get("_words", 0))
    )
    phrases = cut_lineage(phrases)
    longest = phrases.agg(F.max(F.size("_words"))).first()[0] or 1
    cut = reviews.select(*keys, tokens(F.col(text_col)).alias("_tokens"))
    # Only the few tokens a phrase can reach travel with a token.
    at = F.posexplode("_tokens").alias("_at", "_token")
    ahead = F.slice("_tokens", F.col("_at") + 1, longest).alias("_ahead")
    placed = cut.select(*keys, "_tokens", at).select(*keys, "_token", ahead)
    found = attach_small(placed, phrases, ["_token"]).filter(F.slice("_ahead", 1, F.size("_words")) == F.col("_words"))
    hits = found.groupBy(*keys, "theme_id").agg(F.count(F.lit(1)).alias("hits"), F.min("place").alias("place"))
    best = hits.groupBy(*keys).agg(F.min(F.struct((-F.col("hits")).alias("_less"), "place", "theme_id")).alias("_best"))
    joined = reviews.select(*keys).join(best, keys, "left")
    return joined.select(
        *keys,
        F.coalesce(F.col("_best.theme_id"), F.lit(default)).alias("theme_id"),
        F.coalesce(-F.col("_best._less"), F.lit(0)).cast("bigint").alias("hits"),
    )


def assign_themes(
    reviews: DataFrame,
    scorer: Callable[[pd.DataFrame], pd.DataFrame],
    batch_size: int = DEFAULT.limits.batch_size,
) -> DataFrame:
    """Assignments of a user scorer, called with batches of (review_id, text, rating).

    Batches are runs of ``batch_size`` reviews in corpus order, as ``payloads.batch_rows``
    numbers them. The scorer returns review_id, theme_id, confidence; if it raises, the
    batch's reviews go to ``other``.
    """
    rows = (
        corpus_position(reviews)
        .withColumn("batch_no", F.floor(F.col("pos") / batch_size).cast("bigint"))
        .select("product_id", "batch_no", "pos", F.col("id").alias("review_id"), "text", "rating")
        .repartition("product_id", "batch_no")
        .sortWithinPartitions("product_id", "batch_no", "pos")
    )

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            found = scorer(batch[["review_id", "text", "rating"]].reset_index(drop=True))
            found = found[["review_id", "theme_id", "confidence"]]
        except Exception:  # a failing model must not lose the batch
            found = pd.DataFrame(
                {"review_id": batch["review_id"], "theme_id": OTHER, "confidence": 0.0}
            )
        first = batch.iloc[0]
        return found.reset_index(drop=True).assign(
            product_id=first["product_id"], batch_no=first["batch_no"], pos=range(len(found))
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            groups = [g for _, g in frame.groupby(["product_id", "batch_no"], sort=False)]
            # The last batch may continue in the next Arrow frame.
            held = groups.pop() if groups else None
            for group in groups:
                yield score(group)
        if held is not None:
            yield score(held)

    return rows.mapInPandas(
        run,
        "review_id string, theme_id string, confidence double, product_id string, batch_no bigint, pos int",
    )
