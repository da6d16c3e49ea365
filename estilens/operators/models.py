"""Model summaries: small domain (estimators S and Q) and third generation (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estilens.functions import comments
from estilens.functions import numbers as N
from estilens.keys import ALL_EMPLOYEES, AREA_SERIES, PERIOD, SELECTION, SERIES
from estilens.operators.periods import CURRENT

# Names shown for the third-generation rows, and their columns
# (link, weight).  The combined row has weight one.
THIRD_GENERATION_ROWS = (
    ("Y1 (Sample)", "y1", "orig_w1"),
    ("State Adj", "y1_st_adj", "orig_w2"),
    ("Synth", "syn", "orig_w3"),
    ("Gen 3", "y_hat", None),
)


def _asked(info: DataFrame) -> DataFrame:
    return info.filter(F.col("this_closing") == F.col("sel_closing"))


def small_domain_model(model: DataFrame, info: DataFrame) -> DataFrame:
    """Links, weights and resulting estimates of the small-domain model.

    Weights hold for private ownership; elsewhere the comment decides between
    y1 and y2.  y4 exists for private series outside the statewide area.
    """
    c = F.col
    owner = F.when(c("series_code").startswith("9"), F.substring("series_code", 4, 1)).otherwise("5")
    asked = (
        _asked(info)
        .filter(c("estimation_type_code").isin("S", "Q"))
        .select(
            *SERIES, *PERIOD, c("estimation_type_code").alias("model_kind"), "pm",
            comments.moved_to_first_link(c("estimation_type_code"), c("analyst_comment")).alias("on_y1"),
        )
        .distinct()
    )
    private = c("owner") == "5"

    def row(name, weight):
        link = c(f"link_{name}")
        return F.struct(
            F.lit(name).alias("estimator"), weight.alias("weight"), link.alias("link"),
            N.to_long(link * c("pm")).alias("estimate"),
            N.to_long(link * c("pm") - c("pm")).alias("otm"),
        )

    y1 = F.when(private, c("weight_y1")).when(c("on_y1"), 1.0).otherwise(0.0)
    y2 = F.when(private, c("weight_y2")).when(c("on_y1"), 0.0).otherwise(1.0)
    base = F.array(row("y1", y1), row("y2", y2))
    with_y4 = F.array(row("y1", y1), row("y2", y2), row("y4", c("weight_y4")))
    rows = F.when(private & (c("area_fips_code") != "00000"), with_y4).otherwise(base)
    keys = [*AREA_SERIES, *PERIOD]
    links = model.filter(c("data_type_code") == ALL_EMPLOYEES).drop("data_type_code")
    return (
        asked.join(links, keys)
        .withColumn("owner", owner)
        .select(*SELECTION, "model_kind", F.explode(rows).alias("r"))
        .select(*SELECTION, "model_kind", "r.*")
    )


def third_gen_model(model: DataFrame, info: DataFrame) -> DataFrame:
    """Link, weight, estimate and change of each third-generation component."""
    c = F.col
    asked = (
        _asked(info).filter(c("estimation_type_code") == "G")
        .select(*SERIES, *PERIOD).distinct()
    )

    def row(label, link, weight):
        estimate = N.round_half_even(c(link) * c("pm_est"))
        return F.struct(
            F.lit(label).alias("model"), c(link).alias("link"),
            (c(weight) if weight else F.lit(1.0)).alias("weight"),
            N.to_long(estimate).alias("est"), N.to_long(estimate - c("pm_est")).alias("otm"),
        )

    rows = F.explode(F.array(*[row(*r) for r in THIRD_GENERATION_ROWS]))
    return (
        model.join(asked, list(SELECTION), "left_semi")
        .select(*SELECTION, rows.alias("r"), "beta", "y2_m")
        .select(*SELECTION, "r.*", "beta", "y2_m")
    )


def of_vintage(models: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of a model table that each release reads: of the current one where its
    estimates are the current ones, else of the archive (there is one).

    needed is the result of periods.vintages_needed; models has the column vintage.
    """
    archived = F.when(F.col("vintage") == CURRENT, CURRENT).otherwise("archive")
    chosen = needed.filter("rank = 0").select(*PERIOD, archived.alias("vintage"))
    return models.join(chosen, [*PERIOD, "vintage"], "left_semi").drop("vintage")
