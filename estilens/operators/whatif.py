"""Re-estimation under proposed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.functions import numbers as N
from estilens.keys import PERIOD, SELECTION, SERIES, UNIT_GROUP

TOTALS = ("apm", "acm", "twpm", "twcm")


def estimate_inputs(summary: DataFrame, info: DataFrame) -> DataFrame:
    """One row per selection: estimate values and the totals of A and T rows.

    A rows count at face value, T rows weighted; each is looked up by its name.
    """
    def total(row: str, column: str) -> Column:
        return N.sum_or_zero(F.when(F.col("sample") == row, F.col(column))).cast("double")

    totals = summary.groupBy(*SELECTION).agg(
        total("A", "pm").alias("apm"), total("A", "cm").alias("acm"),
        total("T", "wpm").alias("twpm"), total("T", "wcm").alias("twcm"),
    )
    asked = info.filter(F.col("this_closing") == F.col("sel_closing")).select(
        *SERIES, *PERIOD, "cm", "pm", "py",
        F.col("birth_death_factor").alias("bdf"), F.col("non_sample_adjustment").alias("nse"),
    ).distinct()
    return asked.join(totals, list(SELECTION))


def unit_changes(detail: DataFrame, units: DataFrame) -> DataFrame:
    """Changes of whole units as changes of their reports.

    units holds the selection, the unit's group and new_flag.
    """
    keys = [*SELECTION, *UNIT_GROUP]
    return detail.join(units.select(*keys, "new_flag").distinct(), keys).select(*SELECTION, "reptstate", "ui", "reptw", "report", "new_flag")


def what_if_reflag(detail: DataFrame, changes: DataFrame, inputs: DataFrame) -> DataFrame:
    """New estimate of each selection if the given reports changed flag.

    changes holds the selection, reptstate, ui, reptw, report and new_flag.
    Each changed report leaves the totals of its flag and joins those of the
    new one; X counts nowhere.  Selections without changes keep their totals.  A
    report named twice changes once; two different flags for it are an error.
    """
    c = F.col
    keys = [*SELECTION, "reptstate", "ui", "reptw", "report"]
    whole = {name: F.coalesce(N.to_long(c(name)), F.lit(0)) for name in ("pm", "cm", "wpm", "wcm")}

    def moved(flag: str, value: Column) -> Column:
        joins = F.when(c("new_flag") == flag, value).otherwise(F.lit(0))
        leaves = F.when(c("flag") == flag, value).otherwise(F.lit(0))
        return F.sum(joins - leaves).cast("double")

    twice = F.raise_error(F.lit("two new flags for one report")).cast("string")
    changes = changes.groupBy(*keys).agg(
        F.when(F.min("new_flag") == F.max("new_flag"), F.max("new_flag")).when(F.max("new_flag").isNotNull(), twice).alias("new_flag")
    )
    deltas = (
        detail.select(*keys, "flag", *[v.alias(n) for n, v in whole.items()])
        .join(changes.select(*keys, "new_flag"), keys)
        .groupBy(*SELECTION)
        .agg(
            moved("A", c("pm")).alias("d_apm"), moved("A", c("cm")).alias("d_acm"),
            moved("T", c("wpm")).alias("d_twpm"), moved("T", c("wcm")).alias("d_twcm"),
            F.count(F.lit(1)).alias("changed_reports"),
        )
    )
    rows = inputs.join(deltas, list(SELECTION), "left").withColumns({
        **{t: c(t) + F.coalesce(f"d_{t}", F.lit(0.0)) for t in TOTALS},
        "changed_reports": F.coalesce("changed_reports", F.lit(0)),
    })
    link = F.when(c("twpm") == 0, F.lit(1.0)).otherwise(N.ratio(c("twcm"), c("twpm")))
    zero = F.lit(0.0)
    estimate = (
        F.floor((F.coalesce("pm", zero) - c("apm")) * c("link") + 0.5).cast("double")
        + c("acm") + F.coalesce("bdf", zero)
    )

    def or_one(name: str) -> Column:
        return F.when(F.coalesce(name, zero) == 0, F.lit(1.0)).otherwise(c(name))

    return (
        rows.withColumn("link", link)
        .withColumn("n_recalc_cm", estimate)
        .withColumns({
            "n_recalc_otm": c("n_recalc_cm") - or_one("pm"),
            "n_recalc_oty": c("n_recalc_cm") - or_one("py"),
        })
        .withColumns({
            "n_recalc_otm_pct": c("n_recalc_otm") / or_one("pm") * 100,
            "n_recalc_oty_pct": c("n_recalc_oty") / or_one("py") * 100,
        })
        .select(*SELECTION, *TOTALS, "changed_reports", "link", "n_recalc_cm",
                "n_recalc_otm", "n_recalc_oty", "n_recalc_otm_pct", "n_recalc_oty_pct")
    )
