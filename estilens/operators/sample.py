"""Weighted sample and its summaries.

A selection (a series in one period) can hold any number of reports, so all
reductions here combine on the map side and none gathers a selection's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from estilens.functions import months as M
from estilens.functions import numbers as N
from estilens.keys import PERIOD, SELECTION, SERIES, keyed

# Display order of the summary rows.
SUMMARY_ORDER = ("T", "A", "Sum", "Coverage", "Pm-Covg", "Inc", "Dec", "Const", "U", "X")


def weighted_sample(sample: DataFrame) -> DataFrame:
    """Add the weight and each report's weighted contribution.

    A down-weight of zero means one.  T rows count weighted, A rows at face
    value, all others not at all.  A projection: filters on keys and periods
    still reach the Parquet scan.
    """
    c = F.col
    flag = c("a_typ_flag")
    downweight = F.when(c("cont_tot_dwnwght") == 0, F.lit(1.0)).otherwise(c("cont_tot_dwnwght"))

    def contribution(name: str) -> Column:
        value = c(name).cast("double")
        return F.when(flag == "T", value * c("wgt")).when(flag == "A", value).otherwise(F.lit(0.0))

    return (
        sample.withColumn("cont_tot_dwnwght", downweight)
        .withColumn("wgt", c("sample_weight") * c("diff_resp_rate") * c("cont_tot_dwnwght"))
        .withColumns({"wpm": contribution("pm_value"), "wcm": contribution("cm_value")})
        .withColumn("wotm", N.round_half_even(c("wcm") - c("wpm")))
    )


def _sums() -> list[Column]:
    c = F.col
    return [
        N.sum_or_zero(c("pm_value")).alias("pm_sum"),
        N.sum_or_zero(c("cm_value")).alias("cm_sum"),
        N.whole_sum(c("wpm")).alias("wpm_whole"),
        N.fraction_sum(c("wpm")).alias("wpm_fraction"),
        N.whole_sum(c("wcm")).alias("wcm_whole"),
        N.fraction_sum(c("wcm")).alias("wcm_fraction"),
    ]


_SUMS = ("pm_sum", "cm_sum", "wpm_whole", "wpm_fraction", "wcm_whole", "wcm_fraction")


def _labelled(weighted: DataFrame, label: Column) -> DataFrame:
    """Reports, units and sums per selection and label (explode() where a row counts under several).

    The sample moves once, by selection and report, so that a large selection stays
    spread out.  A report's sums and its units, one as a rule, come together where its
    rows are; then only one row per partition, label and unit moves, and of all of
    them one per label.  Several distinct counts in one aggregate would multiply the
    rows before the shuffle.
    """
    keys = keyed(weighted, *SELECTION)
    # Null reports and units count as one more value each.
    reports = (
        weighted.select(*keys, "report_id", "selected_ui_number", "pm_value", "cm_value", "wpm", "wcm", "a_typ_flag")
        .repartition(*keys, "report_id")
        .withColumn("label", label)
        .groupBy(F.xxhash64(*keys, "label", "report_id").alias("spread"), *keys, "label", "report_id")  # sets are sorted, by the hash first
        .agg(*_sums(), F.collect_set(F.struct("selected_ui_number")).alias("units"))
    )
    first = F.col("place") == 0
    counts = {"rep_count": F.lit(1).cast("bigint"), **{c: F.col(c) for c in _SUMS}}
    units = (
        reports.select(*keys, "label", F.posexplode("units").alias("place", "unit"), *_SUMS)
        .groupBy(*keys, "label", "unit")
        .agg(*[F.sum(F.when(first, value).otherwise(F.lit(0))).alias(c) for c, value in counts.items()])
    )
    return units.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("ui_count"), *[F.sum(c).alias(c) for c in counts]
    )


def _shown(flag: Column) -> dict[str, Column]:
    c = F.col
    return {
        "pm_emp": c("pm_sum").cast("double"),
        "cm_emp": c("cm_sum").cast("double"),
        "pm_weighted_emp": N.rounded_total(c("wpm_whole"), c("wpm_fraction")),
        "cm_weighted_emp": N.rounded_total(c("wcm_whole"), c("wcm_fraction")),
        "unwotm": F.when(flag.isin("U", "X"), F.lit(0).cast("bigint"))
        .otherwise(c("cm_sum") - c("pm_sum")),
    }


def _summary_columns(keys: list[str]) -> list[str]:
    return [*keys, "rep_count", "ui_count", "pm_emp", "cm_emp",
            "pm_weighted_emp", "cm_weighted_emp", "unwotm"]


def _direction() -> Column:
    change = F.col("cm_value").cast("bigint") - F.col("pm_value").cast("bigint")
    return F.when(change > 0, "Inc").when(change < 0, "Dec").otherwise("Const")


def flag_summary(weighted: DataFrame) -> DataFrame:
    """Reports, units, sums and weighted sums per flag of each selection."""
    return _summary(weighted, F.col("a_typ_flag"))


def sign_summary(weighted: DataFrame) -> DataFrame:
    """The same measures for A and T rows by direction of change."""
    return _summary(weighted.filter(F.col("a_typ_flag").isin("A", "T")), _direction())


def _summary(weighted: DataFrame, label: Column) -> DataFrame:
    keys = keyed(weighted, *SELECTION)
    return (
        _labelled(weighted, label).withColumnRenamed("label", "a_typ_flag")
        .withColumns(_shown(F.col("a_typ_flag")))
        .select(*_summary_columns([*keys, "a_typ_flag"]))
    )


def sample_total(flags: DataFrame) -> DataFrame:
    """A and T rows added up; distinct counts are added, not counted again.

    Selections without such rows still get a row of zeros.
    """
    used = F.col("a_typ_flag").isin("A", "T")
    sums = {c: N.sum_or_zero(F.when(used, F.col(c))).alias(c)
            for c in _summary_columns([])}
    return flags.groupBy(*SELECTION).agg(*sums.values()).withColumn("a_typ_flag", F.lit("Sum")).select(
        *_summary_columns([*SELECTION, "a_typ_flag"]))


def published_values(info: DataFrame) -> DataFrame:
    """Prior-month and published value of each selection, cut to whole numbers."""
    return (
        info.filter(F.col("this_closing") == F.col("sel_closing"))
        .select(
            *keyed(info, *SERIES), *PERIOD,
            N.to_long(F.col("pm")).alias("pm_est"), N.to_long(F.col("cm")).alias("pub_est"),
        )
        .distinct()
    )


def coverage(total: DataFrame, published: DataFrame) -> DataFrame:
    """The Sum row as a share of the prior-month or published estimate."""
    zero = F.lit(0).cast("bigint")
    return total.join(published, list(SELECTION)).select(
        *SELECTION,
        F.lit("Coverage").alias("a_typ_flag"),
        zero.alias("rep_count"), zero.alias("ui_count"),
        *[N.ratio(F.col(f"{c}_emp"), F.col(base)).alias(f"{c}_emp")
          for c, base in (("pm", "pm_est"), ("cm", "pub_est"),
                          ("pm_weighted", "pm_est"), ("cm_weighted", "pub_est"))],
        zero.alias("unwotm"),
    )


def pm_coverage(weighted: DataFrame, published: DataFrame) -> DataFrame:
    """The prior month's whole sample as a share of the prior-month estimate.

    As released, its weighted current month is divided by the published value.
    """
    zero = F.lit(0).cast("bigint")
    totals = (
        weighted.groupBy(*SELECTION).agg(*_sums())
        .withColumns(_shown(F.lit("")))
        .select(*SERIES, *[F.col(c).alias(f"src_{c}") for c in PERIOD],
                "pm_emp", "cm_emp", "pm_weighted_emp", "cm_weighted_emp")
    )
    pm_y, pm_m, pm_c = M.prior_month_release(*[F.col(c) for c in PERIOD])
    asked = published.withColumns({"src_year": pm_y, "src_month": pm_m, "src_estimate_type_code": pm_c})
    return asked.join(totals, [*SERIES, *[f"src_{c}" for c in PERIOD]], "left").select(
        *SELECTION,
        F.lit("Pm-Covg").alias("a_typ_flag"),
        zero.alias("rep_count"), zero.alias("ui_count"),
        *[N.ratio(F.coalesce(f"{c}_emp", F.lit(0.0)), F.col(base)).alias(f"{c}_emp")
          for c, base in (("pm", "pm_est"), ("cm", "pm_est"),
                          ("pm_weighted", "pm_est"), ("cm_weighted", "pub_est"))],
        zero.alias("unwotm"),
    )


def sample_summary(weighted: DataFrame, published: DataFrame) -> DataFrame:
    """All summary rows of every selection, from one pass over the sample.

    Each report is counted once under its flag and, if used, once under its
    direction (see _labelled).  What leaves that is a handful of rows per
    selection.  They meet the published values in one exchange on the series,
    which also serves the look back to the prior month; nothing reads the sample
    again.
    """
    used = F.col("a_typ_flag").isin("A", "T")

    def mark(by_sign: int, label: Column) -> Column:
        return F.struct(F.lit(by_sign).alias("by_sign"), label.alias("label"))

    flag = mark(0, F.col("a_typ_flag"))
    labelled = (
        _labelled(weighted, F.explode(F.when(used, F.array(flag, mark(1, _direction()))).otherwise(F.array(flag))))
        .withColumns({"by_sign": F.col("label.by_sign"), "label": F.col("label.label")})
        .withColumns(_shown(F.col("label")))
    )
    keys, series = keyed(weighted, *SELECTION), keyed(weighted, *SERIES)

    shown = _summary_columns([])
    is_flag = F.col("by_sign") == 0
    is_used = is_flag & F.col("label").isin("A", "T")
    everything = {
        c: F.sum(F.when(is_flag, F.col(c)))
        for c in _SUMS
    }
    row = F.when(F.col("by_sign").isNotNull(), F.struct(F.col("label").alias("sample"), *shown))
    per_selection = (
        labelled.unionByName(published.withColumn("published", F.lit(True)), allowMissingColumns=True)
        .repartition(*series)
        .groupBy(*keys)
        .agg(
            F.max("published").alias("published"),
            F.max("pm_est").alias("pm_est"),
            F.max("pub_est").alias("pub_est"),
            F.collect_list(row).alias("rows"),
            F.struct(*[N.sum_or_zero(F.when(is_used, F.col(c))).alias(c) for c in shown]).alias("total"),
            F.struct(*[v.alias(c) for c, v in everything.items()]).alias("all"),
        )
        .withColumns(look_back_distances())
    )
    prior = prior_release_value(F.col("all"), Window.partitionBy(*series).orderBy("code"))

    def share(part: Column, base: str) -> Column:
        return N.ratio(part, F.col(base))

    def line(name, rep, ui, pm, cm, wpm, wcm, otm):
        return F.struct(
            F.lit(name).alias("sample"), rep.alias("rep_count"), ui.alias("ui_count"),
            pm.alias("pm_emp"), cm.alias("cm_emp"),
            wpm.alias("pm_weighted_emp"), wcm.alias("cm_weighted_emp"), otm.alias("unwotm"),
        )

    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    t, p = F.col("total"), F.col("prior")
    prior_wpm = N.rounded_total(p["wpm_whole"], p["wpm_fraction"])
    prior_wcm = N.rounded_total(p["wcm_whole"], p["wcm_fraction"])
    extra = F.array(
        line("Sum", *[t[c] for c in shown]),
        line("Coverage", zero, zero,
             share(t["pm_emp"], "pm_est"), share(t["cm_emp"], "pub_est"),
             share(t["pm_weighted_emp"], "pm_est"), share(t["cm_weighted_emp"], "pub_est"), zero),
        line("Pm-Covg", zero, zero,
             share(F.coalesce(p["pm_sum"].cast("double"), none), "pm_est"),
             share(F.coalesce(p["cm_sum"].cast("double"), none), "pm_est"),
             share(F.coalesce(prior_wpm, none), "pm_est"),
             share(F.coalesce(prior_wcm, none), "pub_est"), zero),
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SUMMARY_ORDER]), F.col("r.sample"))
    return (
        per_selection.withColumn("prior", prior)
        .filter("published")
        .select(*SELECTION, F.explode(F.concat("rows", extra)).alias("r"))
        .select(
            *SELECTION,
            order.alias("row_order"),
            F.col("r.sample").alias("sample"),
            F.col("r.rep_count").alias("report"),
            F.col("r.ui_count").alias("ui"),
            F.col("r.pm_emp").alias("pm"),
            F.col("r.cm_emp").alias("cm"),
            F.col("r.unwotm").alias("otm"),
            F.col("r.pm_weighted_emp").alias("wpm"),
            F.col("r.cm_weighted_emp").alias("wcm"),
        )
    )


def look_back_distances() -> dict[str, Column]:
    """How many release codes before a row's own release its prior month and its
    prior closing lie (a month is 10 codes, a closing is 1)."""
    year, month, closing = (F.col(c) for c in PERIOD)
    before = M.release_code(*M.prior_month_release(year, month, closing))
    return {
        "code": M.release_code(year, month, closing),
        "pm_distance": M.release_code(year, month, closing) - before,
        "prior_distance": (closing.cast("int") - M.earlier_closing(month, closing).cast("int")).cast("bigint"),
    }


def _value_at(value: Column, in_order: WindowSpec, distance: str, cases: tuple[int, ...]) -> Column:
    """The value exactly distance codes back; the cases list every distance there is.

    A fixed distance is a range frame, so looking back needs no join of the
    table with itself.
    """
    return F.coalesce(*[
        F.when(F.col(distance) == n, F.min(value).over(in_order.rangeBetween(-n, -n))) for n in cases
    ])


def prior_release_value(value: Column, in_order: WindowSpec) -> Column:
    """Value of the release the prior month is taken from; in_order sorts by code."""
    return _value_at(value, in_order, "pm_distance", (8, 9, 10, 11, 12))


def earlier_release_value(value: Column, in_order: WindowSpec) -> Column:
    """Value of the same month's release before the row's own (none for closing 1)."""
    return _value_at(value, in_order, "prior_distance", (1, 2))


def sample_link(summary: DataFrame) -> DataFrame:
    """Weighted current over prior month of the first summary row (T, else A, ...)."""
    first = F.min(F.struct("row_order", "wpm", "wcm"))
    rows = summary.filter(F.col("row_order").isNotNull()).groupBy(*SELECTION).agg(first.alias("f"))
    link = N.ratio(N.to_long(F.col("f.wcm")), N.to_long(F.col("f.wpm")))
    return rows.select(*SELECTION, N.round_half_even(link, 4).alias("link"))
