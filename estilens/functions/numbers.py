"""Rounding, ratios and sums whose result does not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fractions are summed as whole multiples of 1e-7: ten million steps per unit
# leave room for about 9e11 rows in one group before a long overflows (and an
# overflow is an error in ANSI mode, never a wrong total).
_STEPS = 10_000_000


def round_half_even(value: Column, places: int = 0) -> Column:
    """Round ties to even.  Adding zero turns -0.0 into 0.0."""
    rounded = F.rint(value) if places == 0 else F.bround(value, places)
    return rounded + F.lit(0.0)


def to_long(value: Column) -> Column:
    """Whole part, cut toward zero."""
    return value.cast("bigint")


def rounded_long(value: Column) -> Column:
    return to_long(F.rint(value))


def nearest_hundred(value: Column) -> Column:
    return round_half_even(value / 100) * 100


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null, not an error, when the divisor is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def whole_sum(value: Column) -> Column:
    """Sum of the whole parts of a double column (pair with fraction_sum)."""
    return sum_or_zero(F.floor(value))


def fraction_sum(value: Column) -> Column:
    """Sum of the fractions of a double column, counted in 1e-7 steps."""
    return sum_or_zero(F.floor((value - F.floor(value)) * _STEPS + 0.5))


def rounded_total(whole: Column, fraction: Column) -> Column:
    """Half-even rounding of whole_sum + fraction_sum, as a double.

    Longs add up the same in any order, so the total does not change with the
    partitioning or when a lost task is run again.
    """
    remainder = fraction % _STEPS
    base = whole + ((fraction - remainder) / _STEPS).cast("bigint")
    up = (remainder > _STEPS // 2) | ((remainder == _STEPS // 2) & (base % 2 != 0))
    return (base + F.when(up, 1).otherwise(0)).cast("double")


def distinct_count(value: Column) -> Column:
    """Number of distinct values where null counts as one more value."""
    return F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))


def agreed_value(value: Column, otherwise: Column) -> Column:
    """The group's value when all rows (nulls included) agree on it.

    Minimum, maximum and counts combine on the map side, unlike one distinct
    count per column, which would multiply the rows before the shuffle.
    """
    rows, filled = F.count(F.lit(1)), F.count(value)
    low, high = F.min(value), F.max(value)
    return F.when((filled == rows) & (low == high), low).when(filled > 0, otherwise)
