"""The small teaching tables: parent rollup, report rows, two-line series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.functions import months as M
from estilens.functions import numbers as N


def parent_rollup(sample: DataFrame) -> DataFrame:
    """Reports added up per parent report of each sample group."""
    return (
        sample.groupBy("sample_group", "parent_report")
        .agg(F.count(F.lit(1)).alias("report_count"),
             *[N.sum_or_zero(F.col(c)).alias(c) for c in ("pm", "cm", "otm")])
        .withColumn("expandable", F.col("report_count") > 1)
    )


def parent_detail(sample: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Report rows (of the given parents) with the id parent-report."""
    if parents is not None:
        sample = sample.join(parents.select("parent_report").distinct(), "parent_report", "left_semi")
    return sample.withColumn("id", F.concat_ws("-", "parent_report", "report"))


def two_line_series(series: DataFrame, name: str | None = None) -> DataFrame:
    """Estimate and benchmark by month, with a month label."""
    if name is not None:
        series = series.filter(F.col("data_series") == name)
    label = M.month_year_label(F.col("year"), F.col("month"))
    return series.select("data_series", "year", "month", label.alias("label"), "estimate", "benchmark")


def options_first_seen(rows: DataFrame, column: str, order: Column) -> DataFrame:
    """Distinct values with the place they were first seen at."""
    return rows.groupBy(F.col(column).alias("option")).agg(F.min(order).alias("first_seen"))


def requested_or_first(options: DataFrame, requested: str) -> DataFrame:
    """The requested option if it exists, else the first one; a single row."""
    hit = F.max(F.when(F.col("option") == requested, F.col("option")))
    return options.agg(F.coalesce(hit, F.min_by("option", "first_seen")).alias("option"))
