"""Rounding of ratios the way correctly rounded decimal output does it.

A quotient such as 469/200 = 2.345 is a decimal tie, but the double next to it lies a
little above or below. Correct rounding looks at that double, so the usual half-up and
half-even helpers, which work on its shortest decimal form, can be 0.01 off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 1 << 20


def scaled_ratio(num: Column, den: Column, digits: int, ties: str = "even") -> Column:
    """``round(num / den, digits)`` times ``10**digits`` as BIGINT; null if ``den`` is 0.

    ``num`` and ``den`` are non-negative whole numbers. Away from a tie whole-number
    arithmetic decides. On a tie the double quotient is compared exactly with the tie point;
    if it is equal, ``ties`` picks the even neighbour or the upper one.
    """
    num, den = num.cast("bigint"), F.nullif(den.cast("bigint"), F.lit(0))
    unit = 10**digits
    top = num * unit
    low = F.call_function("div", top, den)
    rest = 2 * F.pmod(top, den)
    odd = 2 * low + 1
    quotient = (num / den) * F.lit(float(_SCALE))
    whole = F.floor(quotient)
    gap = (odd * _SCALE - 2 * unit * whole).cast("double") - 2 * unit * (quotient - whole)
    up_on_equal = (F.pmod(low, F.lit(2)) == 1) if ties == "even" else F.lit(True)
    up = (
        F.when(rest > den, True)
        .when(rest < den, False)
        .when(gap < 0, True)
        .when(gap > 0, False)
        .otherwise(up_on_equal)
    )
    return low + up.cast("bigint")


def ratio_2dp(num: Column, den: Column) -> Column:
    """``num / den`` rounded to two decimals, null where ``den`` is 0."""
    return scaled_ratio(num, den, 2) / F.lit(100.0)


def hundredths(c: Column) -> Column:
    """Whole hundredths of a number already rounded to two decimals."""
    return F.round(c * 100).cast("bigint")


def one_decimal(c: Column, ties: str = "even") -> Column:
    """A two-decimal, non-negative number as text with one decimal."""
    tenths = scaled_ratio(hundredths(c), F.lit(100), 1, ties)
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")
    )
