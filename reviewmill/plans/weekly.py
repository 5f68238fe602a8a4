"""The weekly job: reviews and assignments to themes, quotes, reports and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, Config
from reviewmill.functions.render import report_markdown
from reviewmill.operators import quotes, reports, themes, validation
from reviewmill.operators.windows import dated
from reviewmill.scale import cut_lineage


@dataclass(frozen=True)
class Themes:
    members: DataFrame  # reviews with their theme before the cap; by week where ``other`` was split
    mapping: DataFrame  # per product, week and theme: the theme it counts as
    stats: DataFrame  # ranked statistics per (product, week, theme)
    top: DataFrame  # the highlighted themes


def build_themes(
    reviews: DataFrame,
    assignments: DataFrame,
    windows: DataFrame,
    cfg: Config = DEFAULT,
    proposals: DataFrame | None = None,
    reassignments: DataFrame | None = None,
) -> Themes:
    """Reconcile assignments, split ``other`` where proposed, cap the themes, compute statistics.

    Every week is built from its own corpus, as if it ran alone. Statistics and cap come from one
    rollup of the members, which is stored, as are the cap and the statistics: a few rows per
    product, week and theme that every later step reads. Members stay lazy; only a split, which
    may differ by week, pairs them with their weeks.
    """
    reviews = dated(reviews, windows, F.least("corpus_from", "reporting_from"), F.col("corpus_to"))
    members = themes.reconcile(reviews, assignments, cfg.themes)
    labels = None
    if proposals is not None and reassignments is not None:
        members = themes.week_members(members, windows)
        key = themes.week_key(members)
        may_split = themes.other_share(members, cfg.themes).filter("split").select(*key)
        allowed = proposals.join(may_split, themes.week_key(proposals))
        members = themes.split_other(members, allowed, reassignments)
        labels = members.filter("new_label IS NOT NULL").select(*key, "theme_id", "new_label").distinct()
    rollup = cut_lineage(themes.member_rollup(members))
    weekly = rollup if "week_ending" in rollup.columns else themes.rollup_by_week(rollup, windows)
    mapping = cut_lineage(themes.cap_mapping(weekly, cfg.themes.max_total))
    stats = themes.theme_stats(themes.merge_rollup(weekly, mapping), windows, cfg.windows, cfg.themes)
    if labels is not None:
        stats = (
            stats.join(labels, ["product_id", "week_ending", "theme_id"], "left")
            .withColumn("label", F.coalesce("new_label", "label"))
            .drop("new_label")
        )
    ranked = cut_lineage(themes.rank_themes(stats))
    return Themes(members, mapping, ranked, themes.top_themes(ranked, cfg.themes.highlight))


def candidate_quotes(built: Themes, windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Quote pool of the highlighted themes."""
    eligible = quotes.eligible_quotes(built.members, windows, built.top, cfg.note, built.mapping)
    return quotes.quote_pool(eligible, cfg.note)


def build_reports(
    built: Themes,
    windows: DataFrame,
    reviews: DataFrame,
    summaries: DataFrame,
    picks: DataFrame,
    actions: DataFrame,
    cfg: Config = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """Report rows with Markdown, and their validation."""
    rows = reports.assemble_reports(built.top, summaries, picks, actions, reviews, windows)
    rows = rows.withColumn("md", report_markdown())
    checked = validation.validate_reports(rows, reviews, built.stats, cfg, F.col("md"))
    return rows, checked


def publishable(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Only validated reports go to the archive."""
    passed = checked.filter("passed").select("product_id", "week_ending")
    return rows.join(passed, ["product_id", "week_ending"], "left_semi")
