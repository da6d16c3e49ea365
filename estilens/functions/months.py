"""Month arithmetic and the release rules, on string year and month codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviated month names in calendar order.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_index(year: Column, month: Column) -> Column:
    """Months since year zero, so that neighbours differ by one."""
    return year.cast("bigint") * 12 + month.cast("bigint") - 1


def index_year(index: Column) -> Column:
    return F.floor(index / 12).cast("string")


def index_month(index: Column) -> Column:
    return F.lpad((index % 12 + 1).cast("string"), 2, "0")


def release_code(year: Column, month: Column, closing: Column) -> Column:
    """One number that orders releases by month, then closing."""
    return month_index(year, month) * 10 + closing.cast("bigint")


def month_name(month: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.coalesce(F.get(names, month.try_cast("int") - 1), month.cast("string"))


def month_year_label(year: Column, month: Column) -> Column:
    return F.concat(month_name(month), F.lit(" "), year.cast("string"))


def short_year(year: Column) -> Column:
    return F.right(year.cast("string"), F.lit(2))


def years_before(year: Column, count: int = 1) -> Column:
    return (year.cast("bigint") - count).cast("string")


def prior_month_release(year: Column, month: Column, closing: Column):
    """Year, month and closing the month before is taken from."""
    before = month_index(year, month) - 1
    source = (
        F.when(month == "01", "3")
        .when((closing == "3") & (month == "12"), "3")
        .when(closing == "3", "4")
        .otherwise("2")
    )
    return index_year(before), index_month(before), source


def year_ago_release(year: Column, month: Column, closing: Column):
    """Year, month and closing the same month of last year is taken from."""
    source = F.when((closing == "3") | (month < "10"), "4").otherwise("3")
    return years_before(year), month, source


def benchmark_year(year: Column, closing: Column) -> Column:
    return F.when(closing == "3", year.cast("string")).otherwise(years_before(year))


def earlier_closing(month: Column, closing: Column) -> Column:
    """The closing released before this one for the same month, if any."""
    return (
        F.when((closing == "3") & (month == "12"), "1")
        .when(closing == "3", "2")
        .when(closing == "2", "1")
    )


def earlier_benchmark_year(year: Column, closing: Column) -> Column:
    own = benchmark_year(year, closing)
    return F.when(closing == "3", years_before(own)).when(closing == "2", own)
