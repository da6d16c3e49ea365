"""Joins of values with intervals, without comparing every row with every interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.functions.sizes import size_gap

#: The line of values is cut into at most so many cells, whatever the number of intervals.
CELLS = 512


def _cell(value: Column, edges: list[float]) -> Column:
    """How many edges are at or below a value, by halving steps over the sorted edges."""
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    table = F.array(*[F.lit(e) for e in edges])
    at = value.cast("double")

    def take(place, step):
        return F.when((place + step <= len(edges)) & (F.get(table, place + step - 1) <= at), place + step).otherwise(place)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), take) if edges else F.lit(0)


def cell_edges(intervals: DataFrame, low: str, high: str, cells: int = CELLS) -> list[float]:
    """Values that cut the line so that about as many interval ends fall between any two.

    One number per cell comes to the driver, however many intervals there are.
    """
    shares = F.array(*[F.lit(k / cells) for k in range(cells + 1)])
    ends = intervals.select(F.explode(F.array(F.col(low).cast("double"), F.col(high).cast("double"))).alias("end"))
    found = ends.filter(F.col("end").isNotNull()).agg(F.percentile_approx("end", shares, F.lit(10 * cells)).alias("e")).first()["e"]
    return sorted(set(found or []))


def in_intervals(
    rows: DataFrame, value: str, intervals: DataFrame, low: str, high: str, how: str = "inner", cells: int = CELLS,
) -> DataFrame:
    """rows with the columns of each interval whose ends, both included, enclose the value.

    Interval ends, sorted and thinned to a fixed number of edges, cut the line into
    cells.  An interval stands in every cell it reaches into, a row in one, so rows
    and intervals meet by an equality, which Spark can broadcast, shuffle and split
    where it is skewed; the ends themselves decide.  Intervals may overlap (a row then
    occurs once for each) and leave gaps (how="left" keeps such rows, with nulls).
    A null end is open; a null value is in no interval; an interval whose ends are the
    wrong way round has no values.
    """
    edges = cell_edges(intervals, low, high, cells)
    first = F.when(F.col(low).isNull(), 0).otherwise(_cell(F.col(low), edges))
    last = F.when(F.col(high).isNull(), len(edges)).otherwise(_cell(F.col(high), edges))
    reached = intervals.filter(F.coalesce(F.col(low) <= F.col(high), F.lit(True))).withColumn(
        "__cell", F.explode(F.sequence(first, last)))
    placed = rows.withColumn("__cell", F.when(F.col(value).isNotNull(), _cell(F.col(value), edges)))
    placed, reached = placed.alias("__rows"), reached.alias("__intervals")
    at, lo, hi = F.col(f"__rows.{value}"), F.col(f"__intervals.{low}"), F.col(f"__intervals.{high}")
    inside = (F.col("__rows.__cell") == F.col("__intervals.__cell")) & (lo.isNull() | (at >= lo)) & (hi.isNull() | (at <= hi))
    return placed.join(reached, inside, how).select("__rows.*", "__intervals.*").drop("__cell")


def sizes_by_table(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """rows(pm, cm, selsize, ...) with pm_size, cm_size and szgap by a table of brackets.

    brackets(size, low, high) is a table like any other: of any length, with gaps (no
    size) and overlaps (the largest size counts).  Only the distinct values, which
    combine before they move, meet the brackets; rows then look theirs up.
    """
    values = rows.select(F.explode(F.array(F.col("pm"), F.col("cm"))).alias("value")).distinct()
    named = brackets.select(F.col("size").alias("__size"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    sizes = in_intervals(values, "value", named, "__low", "__high").groupBy("value").agg(F.max("__size").cast("bigint").alias("__size"))
    for name in ("pm", "cm"):
        rows = rows.join(sizes.select(F.col("value").alias(name), F.col("__size").alias(f"{name}_size")), name, "left")
    return rows.withColumn("szgap", size_gap(F.col("pm_size"), F.col("cm_size"), F.col("selsize")))
