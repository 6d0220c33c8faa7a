"""Rounding, sums and means.

Spark's ``round`` is half-up. Results here are half-even on the scaled double, which is what
array libraries do and what any engine with a half-even integer rounding reproduces. Sums and
means are those of doubles, without the noise beyond nine decimals; NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A sum of doubles depends on the order of its terms beyond this; it must not decide a decimal tie.
NOISE_PLACES = 9


def round_even(c: Column, places: int = 0) -> Column:
    """Round half to even at ``places`` decimals."""
    c = c.cast("double")
    if places == 0:
        return F.rint(c)
    scale = F.lit(float(10**places))
    return F.rint(c * scale) / scale


def known(c: Column) -> Column:
    """The value as a double, null if it is NaN."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def total(c: Column) -> Column:
    """Sum of the known values, without noise; null without any."""
    return round_even(F.sum(known(c)), NOISE_PLACES)


def mean(c: Column) -> Column:
    """Mean of the known values, without noise; null without any."""
    return round_even(F.avg(known(c)), NOISE_PLACES)


def int_mean(c: Column) -> Column:
    """Mean of an integer column through an exact integer sum."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def rate(condition: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.try_divide(F.count_if(condition).cast("double"), F.count(F.lit(1)))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def pct(c: Column, places: int = 2) -> Column:
    """Fraction to percent."""
    return round_even(c * F.lit(100.0), places)
