"""Quote candidates: eligible reviews, ranked by how typical they are, without near copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.config import DEFAULT, NoteConfig
from reviewmill.functions.pii import PLACEHOLDER
from reviewmill.functions.text import strip
from reviewmill.operators.themes import week_key
from reviewmill.operators.windows import in_window
from reviewmill.scale import attach_small, cut_lineage
from reviewmill.workers import drop_similar, pick_front

GROUP = ["product_id", "week_ending", "theme_id"]
_PICK = (
    "product_id string, week_ending date, theme_id string, id string, date date, rating int, "
    "text string, distance double, seq int, more boolean, last_distance double, last_id string"
)


def quotable(body: Column, cfg: NoteConfig = DEFAULT.note) -> Column:
    """Length within bounds and no redaction marker left in the text."""
    t = strip(body)
    return F.length(t).between(cfg.quote_min_chars, cfg.quote_max_chars) & ~t.rlike(PLACEHOLDER)


def eligible_quotes(
    members: DataFrame,
    windows: DataFrame,
    themes: DataFrame,
    cfg: NoteConfig = DEFAULT.note,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Quotable reviews of the given themes in their reporting window, with their ``distance``.

    ``distance`` is how far the rating lies from the theme's weekly average; a missing rating
    or average counts as 3. The row-local text tests come before the joins. ``mapping`` is the
    theme cap by product and week, where members don't follow it yet.
    """
    usable = members.filter(quotable(F.col("text"), cfg))
    averages = themes.select(*GROUP, "avg_rating_week")
    usable = usable.select(*week_key(usable), "id", "date", "rating", "text", "theme_id")
    if "week_ending" in usable.columns:
        spans = windows.select("product_id", "week_ending", "reporting_from", "reporting_to")
        inside = F.col("date").between(F.col("reporting_from"), F.col("reporting_to"))
        dated = attach_small(usable, spans, ["product_id", "week_ending"]).filter(inside)
    else:
        dated = in_window(usable, windows)
    if mapping is not None:
        dated = attach_small(dated, mapping, GROUP).withColumn("theme_id", F.col("merged_id"))
    distance = F.abs(F.coalesce(F.col("rating"), F.lit(3)) - F.coalesce(F.col("avg_rating_week"), F.lit(3.0)))
    return (
        attach_small(dated, averages, GROUP)
        .withColumn("distance", distance)
        .select(*GROUP, "id", "date", "rating", "text", "distance")
    )


def rank_quotes(eligible: DataFrame, n: int | None = None) -> DataFrame:
    """Add ``rank`` within theme and week. With ``n``, only the first ``n`` rows are kept, and
    each input task forwards no more than that per theme."""
    order = Window.partitionBy(*GROUP).orderBy("distance", "id")
    ranked = eligible.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def quote_pool(eligible: DataFrame, cfg: NoteConfig = DEFAULT.note, front: int = 256) -> DataFrame:
    """Up to ``max_candidates`` quotes per theme and week, none a near copy of an earlier one.

    The rule is greedy: in rank order, a row is kept unless its similarity to an already kept
    row reaches the threshold. It is evaluated exactly, in rounds, with at most ``front`` rows
    of a theme in one task:

    1. Identical texts collapse to their first row; later ones could never be kept.
    2. The first ``front`` rows of each theme are searched in order.
    3. Only where that leaves a theme short and rows behind the front remain: those rows are
       compared with the new picks wherever they lie, near copies go, and the survivors form
       the next front.

    The first survivor of a round is always kept, so ``max_candidates`` rounds suffice, however
    many near copies a theme holds.
    """
    first = F.min_by(F.struct("id", "date", "rating", "distance"), F.struct("distance", "id"))
    rows = (
        eligible.groupBy(*GROUP, "text")
        .agg(first.alias("_first"))
        .select(*GROUP, "text", "_first.*")
        .withColumns({"need": F.lit(cfg.max_candidates), "taken": F.lit(0)})
    )
    picked: list[DataFrame] = []
    for _ in range(cfg.max_candidates):
        picks = cut_lineage(
            rank_quotes(rows, front + 1)
            .groupBy(*GROUP)
            .applyInPandas(pick_front(cfg.similarity, front), _PICK)
        )
        picked.append(picks)
        short = (
            picks.filter("more")
            .groupBy(*GROUP, "last_distance", "last_id")
            .agg(F.max("seq").alias("taken"), F.collect_list("text").alias("kept"))
            .filter(F.col("taken") < cfg.max_candidates)
        )
        if short.isEmpty():
            break
        behind = F.struct("distance", "id") > F.struct(
            F.col("last_distance").alias("distance"), F.col("last_id").alias("id")
        )
        rest = (
            attach_small(rows.drop("need", "taken"), short, GROUP)
            .filter(behind)
            .withColumn("need", cfg.max_candidates - F.col("taken"))
            .drop("last_distance", "last_id")
        )
        schema = rest.drop("kept").schema
        rows = cut_lineage(rest.mapInPandas(drop_similar(cfg.similarity), schema))
    pool = reduce(DataFrame.unionByName, picked)
    return pool.select(*GROUP, "id", "date", "rating", "text", "distance", F.col("seq").alias("rank"))
