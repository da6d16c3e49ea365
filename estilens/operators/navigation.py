"""Stepping between areas and series, and repairing invalid codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estilens.functions import codes as C

# Two-digit sectors that also match on their first digit.
SECTOR_FAMILIES = ("31", "32", "41", "42", "43")


def series_navigation(catalog: DataFrame) -> DataFrame:
    """Where one step leads from each (state, area, series).

    Area steps go to the nearest areas that have the same series.  Series steps
    stay in the area and, at its edge, continue with the last or first series
    of the area next to it.  Targets carry their highest datatype.

    Windows are keyed by area (its series) or by series (its areas), and the
    area order of a state is taken from one row per area, so no window ever
    holds all the rows of a state.
    """
    series = catalog.groupBy("state", "area", "series").agg(
        F.max_by("datatype", C.code_order(F.col("datatype"))).alias("datatype")
    )
    stop = F.struct("area", "series", "datatype")
    in_area = Window.partitionBy("state", "area").orderBy("series")
    same_series = Window.partitionBy("state", "series").orderBy("area")
    areas = Window.partitionBy("state").orderBy("area")

    edges = (
        series.groupBy("state", "area")
        .agg(F.min(F.struct("series", "datatype")).alias("low"),
             F.max(F.struct("series", "datatype")).alias("high"))
        .select(
            "state", "area",
            F.lag(F.struct("area", "high.series", "high.datatype")).over(areas).alias("before"),
            F.lead(F.struct("area", "low.series", "low.datatype")).over(areas).alias("after"),
        )
    )
    steps = (
        series.select(
            "state", "area", "series",
            F.lag(stop).over(same_series).alias("pa"), F.lead(stop).over(same_series).alias("na"),
            F.lag(stop).over(in_area).alias("ps"), F.lead(stop).over(in_area).alias("ns"),
        )
        .join(edges, ["state", "area"])
        .withColumn("ps", F.coalesce("ps", "before"))
        .withColumn("ns", F.coalesce("ns", "after"))
    )
    return steps.select(
        "state", "area", "series",
        F.col("pa.area").alias("prev_area"), F.col("pa.datatype").alias("prev_area_datatype"),
        F.col("na.area").alias("next_area"), F.col("na.datatype").alias("next_area_datatype"),
        F.col("ps.area").alias("prev_series_area"), F.col("ps.series").alias("prev_series"),
        F.col("ps.datatype").alias("prev_series_datatype"),
        F.col("ns.area").alias("next_series_area"), F.col("ns.series").alias("next_series"),
        F.col("ns.datatype").alias("next_series_datatype"),
    )


def closest_code(requests: DataFrame, options: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each requested code by itself if offered, else by the option
    sharing the longest prefix (two characters or more), else by the first one.

    requests has the keys and a code column; options has the keys and an
    option column.  Options are first reduced to the smallest one per key and
    prefix, so a request meets at most one row per prefix length instead of
    every option that starts alike.  The empty prefix stands for "first option";
    an exact match is the longest prefix and the smallest option that has it.
    """
    prefixes = F.transform(
        F.sequence(F.lit(0), F.length("option")),
        lambda n: F.substring(F.col("option"), F.lit(1), n),
    )
    first_with = (
        # A catalog has many rows per option: unfold each option once.
        options.filter(F.col("option") != "").select(*keys, "option").distinct()
        .select(*keys, "option", F.explode(prefixes).alias("prefix"))
        .groupBy(*keys, "prefix")
        .agg(F.min("option").alias("option"))
    )

    code = F.coalesce("code", F.lit(""))
    length = F.length(code)
    shortest = F.least(F.lit(2), F.greatest(length, F.lit(1)))
    usable = F.filter(F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
                      lambda n: (n >= shortest) & (n <= length))
    probes = F.concat(
        F.array(F.struct(F.lit("").alias("prefix"), F.lit(0).alias("score"))),
        F.transform(usable, lambda n: F.struct(
            F.substring(code, F.lit(1), n).alias("prefix"), n.alias("score"))),
        F.when(
            F.substring(code, 1, 2).isin(*SECTOR_FAMILIES),
            F.array(F.struct(F.substring(code, 1, 1).alias("prefix"), F.lit(2).alias("score"))),
        ).otherwise(F.array().cast("array<struct<prefix:string,score:int>>")),
    )
    ranked = F.struct((-F.col("score")).alias("rank"), F.col("option"))
    return (
        requests.select(*keys, "code").distinct()
        .select(*keys, "code", F.explode(probes).alias("probe"))
        .select(*keys, "code", "probe.*")
        .join(first_with, [*keys, "prefix"], "left")
        .groupBy(*keys, "code")
        .agg(F.min(F.when(F.col("option").isNotNull(), ranked)).alias("best"))
        .select(*keys, "code", F.coalesce("best.option", F.lit("")).alias("chosen"))
    )


def highest_or_requested(requests: DataFrame, options: DataFrame, keys: list[str]) -> DataFrame:
    """Keep each requested code if it is offered, else take the highest option."""
    offered = options.select(*keys, F.col("option").alias("code")).distinct().withColumn("offered", F.lit(True))
    highest = options.groupBy(*keys).agg(F.max_by("option", C.code_order(F.col("option"))).alias("highest"))
    return (
        requests.select(*keys, "code").distinct()
        .join(offered, [*keys, "code"], "left")
        .join(highest, keys, "left")
        .select(*keys, "code",
                F.when(F.col("offered"), F.col("code"))
                .otherwise(F.coalesce("highest", F.lit(""))).alias("chosen"))
    )
