"""Report text: word counts, Markdown, the summary letter and small display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.dates import iso_week_label
from reviewmill.functions.numbers import one_decimal
from reviewmill.functions.text import BLANK, BLANKS, strip

REPORT_TITLE = "Weekly Review Report"

_BODY_TOKEN = rf"(?<![^{BLANK}])[^{BLANK}A-Za-z0-9]*+[A-Za-z0-9][^{BLANK}]*+"

# Arrow text per trend.
TREND_TEXT = {"rising": "↑ rising", "falling": "↓ falling", "steady": "→ steady"}

# Short tags of the default themes.
SHORT_TAGS = {
    "trading": "Trading",
    "payments": "Payments",
    "withdrawals": "Withdrawals",
    "kyc": "KYC",
    "onboarding": "Onboarding",
}


def body_words(themes: Column, quotes: Column, actions: Column) -> Column:
    """Words of summaries, quotes, action titles and details, Markdown signs not counted."""
    prose = F.concat_ws(
        " ",
        F.transform(themes, lambda t: t["summary"]),
        F.transform(quotes, lambda q: q["text"]),
        F.transform(actions, lambda a: F.concat_ws(" ", a["title"], a["detail"])),
    )
    return F.regexp_count(F.regexp_replace(prose, '[*_`>"#]', " "), F.lit(_BODY_TOKEN))


def stars(avg: Column, missing: str = "n/a", ties: str = "even") -> Column:
    return F.coalesce(F.concat(one_decimal(avg, ties), F.lit("★")), F.lit(missing))


def trend_text(trend: Column) -> Column:
    out = F.when(trend == "rising", TREND_TEXT["rising"]).when(trend == "falling", TREND_TEXT["falling"])
    return out.otherwise(TREND_TEXT["steady"])


def _numbered(rows: Column, line) -> Column:
    return F.transform(rows, lambda row, i: F.concat((i + 1).cast("string"), F.lit(". "), line(row)))


def theme_lines(themes: Column) -> Column:
    def line(t: Column) -> Column:
        return F.concat(
            F.lit("**"),
            t["label"],
            F.lit(" — "),
            t["count_week"].cast("string"),
            F.lit(" reviews, "),
            F.coalesce(F.concat(F.lit("avg "), one_decimal(t["avg_rating_week"]), F.lit("★")), F.lit("avg n/a")),
            F.lit(", "),
            trend_text(t["trend"]),
            F.lit(".** "),
            t["summary"],
        )

    return _numbered(themes, line)


def action_lines(actions: Column) -> Column:
    return _numbered(actions, lambda a: F.concat(F.lit("**"), a["title"], F.lit(".** "), a["detail"]))


def report_markdown(
    title: str = REPORT_TITLE, package_id: str = "", store_label: str = "Play Store"
) -> Column:
    """The report as Markdown, from the columns of a report row."""
    reporting, corpus = F.col("reporting_window"), F.col("corpus_window")
    heading = F.concat(
        F.lit(f"# {title} — "), F.col("product_name"), F.lit(" — week ending "), F.col("week_ending").cast("string")
    )
    weeks = F.floor(F.datediff(corpus["to"], corpus["from"]) / 7)
    meta = F.concat(
        F.lit(f"{store_label} · {package_id} · "),
        F.col("review_count_week").cast("string"),
        F.lit(" reviews · "),
        F.day(reporting["from"]).cast("string"),
        F.lit("–"),
        F.date_format(reporting["to"], "d MMM"),
        F.lit(" · "),
        F.coalesce(F.concat(F.lit("avg "), one_decimal(F.col("avg_rating_week")), F.lit("★")), F.lit("avg n/a")),
        F.lit(" (corpus: "),
        F.format_number(F.col("review_count_corpus"), 0),
        F.lit(" reviews / "),
        weeks.cast("string"),
        F.lit(" weeks)"),
    )
    note = F.concat(F.lit("*"), F.nullif(F.col("window_note"), F.lit("")), F.lit("*"))
    quotes = F.transform(F.col("quotes"), lambda q: F.concat(F.lit('> "'), q["text"], F.lit('"')))
    body = F.concat_ws(
        "\n",
        heading,
        meta,
        note,
        F.lit(""),
        F.lit("## Top themes"),
        theme_lines(F.col("top_themes")),
        F.lit(""),
        F.lit("## What users said"),
        quotes,
        F.lit(""),
        F.lit("## Action ideas"),
        action_lines(F.col("actions")),
    )
    return F.concat(body, F.lit("\n"))


def summary_letter(title: str = REPORT_TITLE, store_label: str = "Play Store") -> Column:
    """The covering letter of a report row: themes with summaries, actions with details."""

    def theme(t: Column) -> Column:
        summary = F.coalesce(F.nullif(strip(t["summary"]), F.lit("")), F.lit("No summary available."))
        return F.concat(t["label"], F.lit("\n   "), summary)

    def action(a: Column) -> Column:
        detail = F.nullif(strip(a["detail"]), F.lit(""))
        return F.concat(a["title"], F.coalesce(F.concat(F.lit("\n   "), detail), F.lit("")))

    def section(rows: Column, line, empty: str) -> Column:
        return F.when(F.size(rows) > 0, F.array_join(_numbered(rows, line), "\n\n")).otherwise(empty)

    week = F.col("week_ending").cast("string")
    return F.concat(
        F.lit(f"Dear Sir/Madam,\n\nPlease find the highlights of the {title} for "),
        F.col("product_name"),
        F.lit(" for the week ending "),
        week,
        F.lit(".\n\nSnapshot: average rating "),
        stars(F.col("avg_rating_week")),
        F.lit(" · "),
        F.col("review_count_week").cast("string"),
        F.lit(f" {store_label} reviews\n\nTop themes\n"),
        section(F.col("top_themes"), theme, "No themes available."),
        F.lit("\n\nAction items\n"),
        section(F.col("actions"), action, "No action items available."),
        F.lit(f"\n\nRegards\n{title}\n"),
    )


def fill_week(template: str, week: Column) -> Column:
    """A subject or title template with its ``{week_ending}`` filled in."""
    return F.replace(F.lit(template), F.lit("{week_ending}"), week.cast("string"))


def append_block(md: Column, week: Column, doc_title: str, title: str = REPORT_TITLE) -> Column:
    """Separator and body for appending to a running document; a title line only if missing."""
    body = F.rtrim(F.coalesce(md, F.lit("")), F.lit(BLANKS))
    titled = F.startswith(F.ltrim(body, F.lit(BLANKS)), F.lit(f"# {title}"))
    head = F.when(titled, F.lit("")).otherwise(F.concat(F.lit("# "), fill_week(doc_title, week), F.lit("\n\n")))
    return F.concat(F.lit("\n\n---\n\n"), head, body, F.lit("\n"))


def corpus_weeks(corpus_from: Column, corpus_to: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.datediff(corpus_to, corpus_from) / 7 + 0.5)).cast("int")


def rating_text(avg: Column) -> Column:
    return F.coalesce(one_decimal(avg, "up"), F.lit("n/a"))


def is_low(avg: Column) -> Column:
    return F.coalesce(avg < 2.5, F.lit(False))


def short_tag(theme_id: Column, label: Column) -> Column:
    """Fixed short name of a default theme, else the label up to ``&`` or ``/``."""
    lowered = F.lower(F.coalesce(theme_id, F.lit("")))
    name = F.coalesce(F.nullif(label, F.lit("")), F.nullif(lowered, F.lit("")), F.lit("Theme"))
    out = F.when(F.lit(False), F.lit(""))
    for key, tag in SHORT_TAGS.items():
        out = out.when(lowered == key, tag)
    return out.otherwise(strip(F.get(F.split(name, "[&/]"), 0)))


def share_path(week_ending: Column) -> Column:
    return F.concat(F.lit("/?week="), iso_week_label(week_ending))
