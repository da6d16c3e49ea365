"""Series catalog: labels, structure, tolerance list, filters and options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estilens.functions import codes as C
from estilens.keys import ALL_EMPLOYEES, AREA_SERIES, SERIES, SERVICE_SECTOR


def dimension_labels(salist: DataFrame, titles: DataFrame) -> DataFrame:
    """Distinct state, area and series codes with their names, in long form."""

    def labels(rows, kind, code, name):
        return rows.select(
            F.lit(kind).alias("dimension"), F.col(code).alias("code"), F.col(name).alias("name")
        )

    return (
        labels(salist, "state", "stid", "state")
        .unionByName(labels(salist, "area", "msa", "area"))
        .unionByName(labels(titles, "series", "series_code", "series_name"))
        .distinct()
        .withColumn("label", C.code_label(
            F.when(F.col("dimension") == "state", C.zero_pad(F.col("code"), 2))
            .when(F.col("dimension") == "area", C.zero_pad(F.col("code"), 5))
            .otherwise(F.col("code")),
            F.col("name"),
        ))
    )


def series_structure(structure: DataFrame, salist: DataFrame, titles: DataFrame,
                     bmrkyr: str) -> DataFrame:
    """Reviewable series of a benchmark year with area and series names.

    The name tables are joined without a hint: Spark sends them to every
    executor only when their measured size is under its threshold.
    """
    reviewable = structure.filter(
        (F.col("year") == bmrkyr)
        & F.col("data_type_code").isin(ALL_EMPLOYEES, SERVICE_SECTOR)
        & F.col("series_type_code").isin("B", "I", "C")
        & (
            (F.col("is_published") == "Y")
            | ((F.col("data_type_code") == ALL_EMPLOYEES) & (F.col("series_type_code") == "B"))
        )
    )
    areas = salist.select(
        F.col("stid").alias("state_fips_code"),
        F.col("msa").alias("area_fips_code"),
        F.col("state").alias("state_name"),
        F.col("area").alias("area_name"),
    )
    seasonal = F.when(F.col("ws_flag") == "1", "Yes").when(F.col("ws_flag") == "0", "No")
    return (
        reviewable.join(areas, ["state_fips_code", "area_fips_code"])
        .join(titles.select("series_code", "series_name"), "series_code", "left")
        .select(
            *SERIES, "series_type_code", "estimation_type_code", "year", "is_published",
            "state_name", "area_name", "series_name",
            F.coalesce(seasonal, F.col("ws_flag")).alias("ws_flag"),
        )
        .distinct()
    )


def oot_series(estimates: DataFrame) -> DataFrame:
    """All-employee rows whose link is outside its tolerance (unknown is not outside)."""
    inside = F.col("estimate_link_relative").between(F.col("lower_tolerance"), F.col("upper_tolerance"))
    return estimates.filter((F.col("data_type_code") == ALL_EMPLOYEES) & ~inside).select(
        *SERIES, "year", "month", "estimate_type_code", F.lit(False).alias("in_tolerance")
    )


def filter_catalog(structure: DataFrame, oot: DataFrame) -> DataFrame:
    """Series to choose from, marked top level and out of tolerance.

    Top level is decided from every datatype of an area's series, before
    estimator D drops out.  The window groups hold the few rows of one series
    and its exchange is the one the join needs.
    """
    top = (F.col("series_type_code") == "B") & (
        (F.col("data_type_code") == SERVICE_SECTOR) | F.col("series_code").startswith("90")
    )
    same_series = Window.partitionBy(*AREA_SERIES)
    outside = oot.select(*AREA_SERIES).distinct().withColumn("outside", F.lit("Y"))
    return (
        structure.select(*SERIES, "series_type_code", "estimation_type_code",
                         F.max(F.when(top, "Y")).over(same_series).alias("top"))
        .filter(F.col("estimation_type_code") != "D")
        .join(outside, list(AREA_SERIES), "left")
        .select(
            F.col("state_fips_code").alias("state"),
            F.col("area_fips_code").alias("area"),
            F.col("series_code").alias("series"),
            F.col("series_type_code").alias("seriestype"),
            F.coalesce("top", F.lit("N")).alias("toplev"),
            F.col("data_type_code").alias("datatype"),
            F.coalesce("outside", F.lit("N")).alias("oot"),
        )
    )


def select_rows(rows: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Equality filters from a dict; blank values and unknown columns are skipped."""
    for column, value in wanted.items():
        if value and column in rows.columns:
            rows = rows.filter(F.col(column) == value)
    return rows


def catalog_options(catalog: DataFrame, top_only: bool = False, oot_only: bool = False) -> DataFrame:
    """Cascading choices: states, a state's areas, an area's series, a series' datatypes.

    One row per choice with the choices above it; the four levels come from a
    single pass and one distinct, which combines on the map side.
    """
    rows = select_rows(catalog, {"toplev": "Y" if top_only else "", "oot": "Y" if oot_only else ""})
    levels = ("state", "area", "series", "datatype")

    def choice(depth):
        above = [F.col(c).alias(c) for c in levels[:depth]]
        rest = [F.lit("").alias(c) for c in levels[depth:-1]]
        return F.struct(
            F.lit(levels[depth]).alias("level"),
            *above,
            *rest,
            F.col(levels[depth]).alias("value"),
        )

    choices = F.explode(F.array(*[choice(depth) for depth in range(len(levels))]))
    return rows.select(choices.alias("o")).select("o.*").filter(F.col("value") != "").distinct()


def option_labels(catalog: DataFrame, labels: DataFrame) -> DataFrame:
    """Menu text of every series of every area, and of the area itself."""
    names = {
        kind: labels.filter(F.col("dimension") == kind)
        .groupBy(F.col("code").alias(kind))
        .agg(F.max("name").alias(f"{kind}_name"))
        for kind in ("area", "series")
    }
    choices = catalog.groupBy("state", "area", "series").agg(F.max("seriestype").alias("seriestype"))
    return (
        choices.join(names["area"], "area", "left")
        .join(names["series"], "series", "left")
        .select(
            "state", "area", "series",
            C.code_label(F.col("area"), F.col("area_name"), 5).alias("area_label"),
            C.series_label(F.col("series"), F.col("seriestype"), F.col("series_name")).alias("series_label"),
        )
    )
