"""Date expressions. All work on local calendar dates, so no time zone is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.text import BLANK, bind, strip

# Month abbreviations of the "Aug 30, 2026" form.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Clock, offset and loose year, month and day forms.
_CLOCK = (
    r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"
)
_YEAR = r"((?!0000)\d{4})"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_DAY = r"(?: (?=[1-9](?!\d)))?(3[01]|[12]\d|0[1-9]|[1-9])"
_HMS = r"(2[0-3]|[01]\d|\d):([0-5]\d|\d):([0-5]\d|\d)"

_DASHED = rf"^{_YEAR}-(\d\d)-(\d\d)$"
_SPACED = rf"^{_YEAR}-{_MONTH}-{_DAY}[{BLANK}]+{_HMS}$"
_ISO = rf"^{_YEAR}-?(\d\d)-?(\d\d).{_CLOCK}$"
_ISO_SHAPE = r"^(?:\d{4}-\d\d-\d\d|\d{8})[^\d]"
_ISO_WEEK = rf"^{_YEAR}(?:-W(\d\d)-([1-7])|W(\d\d)([1-7]))(?:.{_CLOCK})?$"
_US = rf"^{_MONTH}/{_DAY}/{_YEAR}$"
_EU = rf"^{_DAY}/{_MONTH}/{_YEAR}$"
_YMD = rf"^{_YEAR}/{_MONTH}/{_DAY}$"
_NAMED = rf"(?i)^({'|'.join(MONTHS)})[{BLANK}]+{_DAY},[{BLANK}]+{_YEAR}$"


def iso_week_day(year: Column, week: Column, weekday: Column) -> Column:
    """Date of an ISO week and weekday (1 = Monday), null for a week the year lacks."""
    first = F.trunc(F.concat(year, F.lit("-01-04")).try_cast("date"), "week")
    day = F.date_add(first, week.cast("int") * 7 + weekday.cast("int") - 8)
    in_year = F.extract(F.lit("YEAROFWEEK"), day) == year.cast("int")
    return F.when((week.cast("int") >= 1) & in_year, day)


def parse_review_date(c: Column) -> Column:
    """Lenient review date; the first matching form decides, anything else is null.

    Accepted: ``yyyy-MM-dd``, ``yyyy-MM-dd H:m:s`` (text after 19 characters ignored), ISO
    date-times (offset ignored), M/d/yyyy before d/M/yyyy, yyyy/M/d and ``MMM d, yyyy``.
    """
    return bind(strip(c), _parse_stripped)


def _parse_stripped(t: Column) -> Column:
    head, short = F.substring(t, 1, 19), F.substring(t, 1, 32)
    spaced = t.contains(" ") & ~t.contains("T")
    isolike = ~spaced & (t.contains("T") | t.contains("+") | t.rlike("-.*-"))
    month_at = F.position(F.lower(F.substring(short, 1, 3)), F.lit(" ".join(MONTHS)))
    month = F.floor(month_at / 4) + 1
    # Every form is rewritten to year-month-day; the cast rejects days the calendar lacks.
    canonical = (
        F.when(t.rlike(_DASHED), t)
        .when(spaced & head.rlike(_SPACED), F.regexp_replace(head, _SPACED, "$1-$2-$3"))
        .when(isolike & t.rlike(_ISO_SHAPE) & t.rlike(_ISO), F.regexp_replace(t, _ISO, "$1-$2-$3"))
        .when(short.rlike(_US), F.regexp_replace(short, _US, "$3-$1-$2"))
        .when(short.rlike(_EU), F.regexp_replace(short, _EU, "$3-$2-$1"))
        .when(short.rlike(_YMD), F.regexp_replace(short, _YMD, "$1-$2-$3"))
        .when(
            short.rlike(_NAMED),
            F.concat(
                F.regexp_extract(short, _NAMED, 3),
                F.lit("-"),
                month.cast("string"),
                F.lit("-"),
                F.regexp_extract(short, _NAMED, 2),
            ),
        )
    )
    by_week = F.when(
        isolike & t.rlike(_ISO_WEEK),
        iso_week_day(
            F.regexp_extract(t, _ISO_WEEK, 1),
            F.concat(F.regexp_extract(t, _ISO_WEEK, 2), F.regexp_extract(t, _ISO_WEEK, 4)),
            F.concat(F.regexp_extract(t, _ISO_WEEK, 3), F.regexp_extract(t, _ISO_WEEK, 5)),
        ),
    )
    return F.coalesce(canonical.try_cast("date"), by_week)


def normalize_import_time(c: Column) -> Column:
    """Source timestamp text as ``yyyy-MM-dd HH:mm:ss``; unknown forms stay as they are.

    Accepted: date-time with a blank or ``T``, ``yyyy-MM-dd``, ``dd-MM-yyyy``, and epoch
    seconds or (above 1e12) milliseconds in UTC.
    """
    return bind(c, _import_time)


def _import_time(c: Column) -> Column:
    head = F.replace(F.substring(c, 1, 19), F.lit("Z"), F.lit(""))
    timed = rf"^{_YEAR}-{_MONTH}-{_DAY}(?:T|[{BLANK}]+){_HMS}$"
    plain = rf"^{_YEAR}-{_MONTH}-{_DAY}$"
    day_first = rf"^{_DAY}-{_MONTH}-{_YEAR}$"
    day = F.when(
        head.rlike(timed) | head.rlike(plain),
        F.regexp_replace(head, rf"^{_YEAR}-{_MONTH}-{_DAY}.*$", "$1-$2-$3"),
    ).when(head.rlike(day_first), F.regexp_replace(head, day_first, "$3-$2-$1"))
    clock = F.when(
        head.rlike(timed),
        F.concat_ws(":", *(F.lpad(F.regexp_extract(head, timed, i), 2, "0") for i in (4, 5, 6))),
    ).otherwise("00:00:00")
    written = F.concat(day.try_cast("date").cast("string"), F.lit(" "), clock)

    number = F.when(
        strip(c).rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"), strip(c).try_cast("double")
    )
    seconds = F.floor(F.when(number > 1e12, number / 1000.0).otherwise(number))
    rest = F.pmod(seconds, F.lit(86400))
    parts = (F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    epoch = F.when(
        seconds.between(-62135596800, 253402300799),
        F.concat(
            F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string"),
            F.lit(" "),
            F.concat_ws(":", *(F.lpad(part.cast("string"), 2, "0") for part in parts)),
        ),
    )
    return F.coalesce(written, epoch, c)


def iso_week_label(day: Column) -> Column:
    """``YYYY-Www`` of a date."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def parse_week(c: Column) -> Column:
    """``YYYY-Www`` to the Saturday of that ISO week, else the first 10 characters as a date."""
    return bind(F.upper(strip(c)), _week_or_date)


def _week_or_date(t: Column) -> Column:
    week = rf"^{_YEAR}[^W]*W[{BLANK}]*\+?(\d{{1,4}})$"
    head = F.substring(t, 1, 10)
    packed = rf"^{_YEAR}(\d\d)(\d\d)$"
    saturday = F.when(
        t.rlike(week),
        iso_week_day(F.regexp_extract(t, week, 1), F.regexp_extract(t, week, 2), F.lit("6")),
    )
    day = F.when(head.rlike(_DASHED), head).when(
        head.rlike(packed), F.regexp_replace(head, packed, "$1-$2-$3")
    )
    return F.when(t.contains("W"), saturday).otherwise(day.try_cast("date"))


def reporting_from(week_ending: Column, days: int = 7) -> Column:
    return F.date_sub(week_ending, days - 1)


def range_label(start: Column, end: Column) -> Column:
    """``Sep 14 – 20, 2026``, with the month or year repeated where it changes."""
    month_day = F.date_format(start, "MMM d")
    return (
        F.when(
            F.year(start) != F.year(end),
            F.concat(month_day, F.lit(", "), F.year(start).cast("string"), F.lit(" – "), F.date_format(end, "MMM d, yyyy")),
        )
        .when(
            F.month(start) != F.month(end),
            F.concat(month_day, F.lit(" – "), F.date_format(end, "MMM d, yyyy")),
        )
        .otherwise(F.concat(month_day, F.lit(" – "), F.date_format(end, "d, yyyy")))
    )


def weeks_behind(week_ending: Column, latest: Column) -> Column:
    """Whole ISO weeks from a report's week to the newest one, never negative."""
    weeks = F.datediff(F.trunc(latest, "week"), F.trunc(week_ending, "week")) / 7
    return F.greatest(F.lit(0), weeks.cast("int"))
