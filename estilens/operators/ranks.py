"""Places in an order, without a window over the whole table or over one selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.plans.stages import staged


def with_rank(
    rows: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "row_index",
    partitions: int | None = None, root: str | None = None,
) -> DataFrame:
    """rows with the place of each (from 1) in the order of its group, as a long.

    Rows are dealt out by ranges of group and order and written once, with the number
    of their range.  A place is the one inside the range plus the rows of the group in
    the ranges before.  Only the first group of a range can have begun in an earlier
    one, so the table of these offsets has at most a row per range, however large a
    group is.  Rows that tie get different places and may stand in different ranges,
    so a tie of any size spreads too.

    Column names that begin with two underscores are the function's own.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by, place = list(group), [*order, F.col("__tie")]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *by, *place)
    ranged = staged(dealt.withColumn("__range", F.spark_partition_id()), "ranges", root)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.sum("__n").over(before)).filter("__before > 0")
    offsets = offsets.select(*[F.col(c).alias(f"__{c}") for c in ("__range", *by)], "__before")
    same = F.col("__range") == F.col("____range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.row_number().over(Window.partitionBy("__range", *by).orderBy(*place)).cast("bigint")
    out = ranged.withColumn("__place", inside).join(F.broadcast(offsets), same, "left")  # at most n rows
    return out.select(*rows.columns, (F.col("__place") + F.coalesce("__before", F.lit(0))).alias(name))
