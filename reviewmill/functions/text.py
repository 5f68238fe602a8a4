"""Text expressions: trimming, word counts, language signals, ids, labels, truncation."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode-aware trimming and splitting treat as blank, once as
# plain text and once as the inside of a Java regex class; and the word characters.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD = r"\p{L}\p{N}_"

# Unicode ranges of scripts that mark a review as not English.
OTHER_SCRIPTS = (
    r"\u0900-\u097F"  # Devanagari
    r"\u0980-\u09FF"  # Bengali
    r"\u0A00-\u0A7F"  # Gurmukhi
    r"\u0A80-\u0AFF"  # Gujarati
    r"\u0B00-\u0B7F"  # Oriya
    r"\u0B80-\u0BFF"  # Tamil
    r"\u0C00-\u0C7F"  # Telugu
    r"\u0C80-\u0CFF"  # Kannada
    r"\u0D00-\u0D7F"  # Malayalam
    r"\u0600-\u06FF"  # Arabic
    r"\u0750-\u077F"  # Arabic supplement
    r"\u4E00-\u9FFF"  # CJK
    r"\u3040-\u30FF"  # Hiragana and Katakana
    r"\uAC00-\uD7AF"  # Hangul
)

# Matches one whole blank-separated token that holds a letter or number. The look-behind
# lets a match start only at a token start, so long runs of symbols stay linear.
_TOKEN = rf"(?<![^{BLANK}])[^{BLANK}\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}][^{BLANK}]*+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    For long expressions that mention their input many times: the generated code stays small,
    where repeating the input would exceed the method size the JVM accepts.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Trim every Unicode blank on both sides (Spark's ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(BLANKS))


def word_count(c: Column) -> Column:
    """Blank-separated tokens with at least one letter or number."""
    return F.regexp_count(c, F.lit(_TOKEN))


def has_words(c: Column, n: int) -> Column:
    """At least ``n`` words; reads no further than the n-th."""
    return c.rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}][^{BLANK}]*+){{{n}}}")


def other_script_chars(c: Column) -> Column:
    return F.when(is_ascii(c), 0).otherwise(F.regexp_count(c, F.lit(f"[{OTHER_SCRIPTS}]")))


def latin_letters(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, string.ascii_letters, ""))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def is_english(c: Column, detector: Callable[[Column], Column] | None = None) -> Column:
    """English decision on stripped text.

    ``detector`` may map the text to ``struct<lang:string, prob:double>`` (a pandas UDF over a
    language library, say). Without one, or where it yields null, the letters decide.
    """
    # Plain ASCII text, the common case, needs none of the script patterns.
    mostly_latin = (
        is_ascii(c)
        | ~c.rlike(f"[{OTHER_SCRIPTS}]")
        | ~c.rlike(f"(?:[{OTHER_SCRIPTS}][^{OTHER_SCRIPTS}]*+){{3}}")
        & (other_script_chars(c) / F.nullif(F.length(c), F.lit(0)) < 0.05)
    )
    only_latin = is_ascii(c) | ~c.rlike(r"[\p{L}\p{Nl}\p{No}&&[^A-Za-z]]")
    by_letters = only_latin & _latin_at_least(c, 8)
    if detector is None:
        # All tests must hold, so the one that rejects most foreign text soonest comes first.
        return F.coalesce(by_letters & mostly_latin, F.lit(False))
    guess = detector(c)
    verdict = F.coalesce(
        (guess.getField("lang") == "en") & (guess.getField("prob") >= 0.5), by_letters
    )
    return F.coalesce(F.when(mostly_latin & _latin_at_least(c, 5), verdict), F.lit(False))


def _latin_at_least(c: Column, n: int) -> Column:
    return c.rlike(f"^(?:[^A-Za-z]*+[A-Za-z]){{{n}}}")


def review_id(day: Column, rating: Column, title: Column, text: Column) -> Column:
    """Content id: 12 hex digits of SHA-1 over date, rating, title and text."""
    payload = F.concat_ws(
        "|",
        day.cast("string"),
        F.coalesce(rating.cast("string"), F.lit("")),
        F.coalesce(title, F.lit("")),
        F.coalesce(text, F.lit("")),
    )
    return F.substring(F.sha1(payload), 1, 12)


def parse_rating(c: Column) -> Column:
    """Number text to a whole star rating 1-5, truncating; anything else is null."""
    t = strip(c.cast("string"))
    digits = r"\d+(?:_\d+)*"
    number = rf"^[+-]?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?$"
    value = F.when(t.rlike(number), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when((value >= 1) & (value < 6), value.cast("int"))


def truncate(c: Column, max_chars: int) -> Column:
    """Stripped text of at most ``max_chars`` characters, cut with an ellipsis."""
    t = strip(c)
    cut = F.rtrim(F.substring(t, 1, max_chars - 1), F.lit(BLANKS))
    return F.when(F.length(t) <= max_chars, t).otherwise(F.concat(cut, F.lit("…")))


def slug(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def title_label(c: Column) -> Column:
    """Theme id to label: underscores to spaces, each run of letters capitalised."""
    runs = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    capital = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(capital, "")


def theme_label(theme_id: Column, seeds: tuple[tuple[str, str], ...]) -> Column:
    """Label from the seed list, else a title-cased id; ``other`` has its own label."""
    from reviewmill.config import OTHER, OTHER_LABEL

    label = F.when(theme_id == OTHER, OTHER_LABEL)
    for seed_id, seed_label in seeds:
        label = label.when(theme_id == seed_id, seed_label)
    return label.otherwise(title_label(theme_id))


def strip_fences(c: Column) -> Column:
    """Drop Markdown fence lines around a model reply."""
    t = strip(c)
    lines = F.filter(F.split(t, "\n"), lambda ln: ~F.startswith(strip(ln), F.lit("```")))
    return F.when(F.startswith(t, F.lit("```")), strip(F.array_join(lines, "\n"))).otherwise(t)
