"""Employment size brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket number, lowest and highest employment.
SIZE_BRACKETS = (
    (1, 0, 9),
    (2, 10, 19),
    (3, 20, 49),
    (4, 50, 99),
    (5, 100, 249),
    (6, 250, 499),
    (7, 500, 999),
    (8, 1000, 999999999999),
)


def size_bracket(employment: Column, brackets: tuple = SIZE_BRACKETS) -> Column:
    """Bracket number; null for values no bracket holds (negative, 9.5, null).

    A chain of conditions takes the place of a range join with a bracket table.
    """
    number = F.lit(None).cast("bigint")
    for size, low, high in reversed(brackets):
        number = F.when(employment.between(low, high), F.lit(size).cast("bigint")).otherwise(number)
    return number


def size_gap(pm_size: Column, cm_size: Column, selection_size: Column) -> Column:
    """How many brackets the report has outgrown the one it was selected in."""
    selected = selection_size.cast("bigint")
    gap = F.greatest(pm_size, cm_size) - selected
    return F.when(selected.isNotNull(), F.greatest(gap, F.lit(0).cast("bigint")))
