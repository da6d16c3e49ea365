"""Report detail, unit rollup, review shortlist and review marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.functions import codes as C
from estilens.functions import numbers as N
from estilens.functions.sizes import size_bracket, size_gap
from estilens.keys import PERIOD, SELECTION, SERIES, UNIT_GROUP, keyed
from estilens.operators import periods as P
from estilens.operators.ranks import with_rank
from estilens.operators.sample import earlier_release_value, look_back_distances, prior_release_value

# The report a row belongs to, which is found again in other periods.
REPORT_KEY = ("reptstate", "ui", "reptw", "report")


def report_columns() -> dict[str, Column]:
    """Display names and derived values shared by detail and history."""
    c = F.col
    return {
        "reptstate": c("rept_sfc"),
        "ui": c("selected_ui_number"),
        "reptw": c("report_with"),
        "report": F.concat(c("rept_sfc"), c("report_id")),
        "naics": c("naics_code"),
        "selsize": c("selection_size").cast("bigint"),
        "weight": c("sample_weight"),
        "origdwght": N.round_half_even(c("original_cont_tot_dwnwght").cast("double"), 2),
        "dwght": N.round_half_even(c("cont_tot_dwnwght").cast("double"), 2),
        "drr": c("diff_resp_rate"),
        "pm": c("pm_value"),
        "cm": c("cm_value"),
        "origflag": c("original_a_typ_flag"),
        "flag": c("a_typ_flag"),
        "otm": c("cm_value").cast("bigint") - c("pm_value").cast("bigint"),
        "wotm": c("wotm"),
        "wpm": N.round_half_even(c("wgt") * c("pm_value")),
        "wcm": N.round_half_even(c("wgt") * c("cm_value")),
        "is_knr": F.coalesce(c("cm_comment_1") == "93", F.lit(False)),
    }


def _history_link(row_type: Column) -> Column:
    shown = [F.coalesce(c, F.lit("")) for c in ("reptstate", "ui", "report", "flag")]
    knr = F.when(F.col("is_knr"), "Y").otherwise("")
    return F.format_string(
        "/sample-history?reptstate=%s&ui=%s&report=%s&flag=%s&knr=%s&row_type=%s",
        *shown, knr, row_type,
    )


def _unit_links(base: str) -> dict[str, Column]:
    state, ui, report = (F.coalesce(c, F.lit("")) for c in ("reptstate", "ui", "report"))
    return {
        "ui_url": F.format_string(f"{base}?q=%s;%s;00000;9999;", state, ui),
        "report_url": F.format_string(f"{base}?q=%s;%s", state, F.substring(report, F.lit(3), F.length(report))),
    }


def sample_detail(weighted: DataFrame, periods: DataFrame | None = None, link_base: str = "", parts: int | None = None) -> DataFrame:
    """One row per report with its prior-month and prior-closing state.

    Weighted values are shown whatever the flag.  With periods, only those
    releases come out, and only the months they look back to are moved.

    Looking back needs no join: a report's rows are put in release order, and
    the release before is a fixed distance away (see prior_release_value).  A
    report has one row per release, so these groups follow the calendar, not the
    data.  A row with an incomplete report key has no counterpart; such rows are
    spread out by a hash instead of meeting in one group of nulls.  What follows from
    a row alone is added after the move.  parts says how many to make of the rows, if
    not as many as Spark would: with parts of a known size no sort outgrows its memory.
    """
    if periods is not None:
        weighted = P.on_periods(weighted, P.detail_sources(periods))
    columns = report_columns()
    added = {name: columns.pop(name) for name in ("otm", "wpm", "wcm")}
    rows = weighted.select(
        *keyed(weighted, *SELECTION),
        *[value.alias(name) for name, value in columns.items()], "wgt",
        C.joined_codes(F.col("pm_comment_1"), F.col("pm_comment_2")).alias("pmcc"),
        C.joined_codes(F.col("cm_comment_1"), F.col("cm_comment_2")).alias("cmcc"),
        F.xxhash64("report_id", "pm_value", "cm_value", "sample_weight", *PERIOD).alias("hash"),
    )
    complete = F.lit(True)
    for name in REPORT_KEY:
        complete &= F.col(name).isNotNull()
    rows = rows.withColumn("spread", F.when(~complete, F.col("hash"))).drop("hash")
    group = [*keyed(weighted, *SERIES), *REPORT_KEY, "spread"]
    rows = rows.repartition(*([parts] if parts else []), *group).withColumns({"pm_value": F.col("pm"), "cm_value": F.col("cm")})
    rows = rows.withColumns({
        **look_back_distances(), **added, "pm_size": size_bracket(F.col("pm")), "cm_size": size_bracket(F.col("cm"))}).drop("pm_value", "cm_value", "wgt")
    in_order = Window.partitionBy(F.xxhash64(*group), *group).orderBy("code")  # a hash decides most comparisons of the sort
    rows = rows.withColumns({
        "before": prior_release_value(F.struct("flag", "dwght"), in_order),
        "earlier": earlier_release_value(F.struct("flag"), in_order),
    })
    if periods is not None:
        rows = P.on_periods(rows, periods)
    known = F.col("spread").isNull()
    return (
        rows.withColumns({
            "pm_flag": F.when(known, F.col("before.flag")),
            "pm_dwght": F.when(known, F.col("before.dwght")),
            "prior_flag": F.when(known, F.col("earlier.flag")),
        })
        .filter(F.col("pm_size").isNotNull() & F.col("cm_size").isNotNull())
        .withColumn("szgap", size_gap(F.col("pm_size"), F.col("cm_size"), F.col("selsize")))
        .withColumns({"history_url": _history_link(F.lit("detail")), **_unit_links(link_base)})
        .select(
            *keyed(weighted, *SELECTION), *REPORT_KEY, "naics", "selsize", "pm_size", "cm_size", "szgap",
            "weight", "pm_dwght", "origdwght", "dwght", "drr", "pm", "cm",
            "pm_flag", "prior_flag", "origflag", "flag", "pmcc", "cmcc",
            "otm", "wotm", "wpm", "wcm", "is_knr", "history_url", "ui_url", "report_url",
        )
    )


def display_order(*keys: str) -> list[Column]:
    """Sort order of report and unit rows: flag, largest change first, ids."""
    return [
        *[F.col(k) for k in keys],
        F.asc_nulls_first("flag"),
        F.abs(F.col("wotm")).desc_nulls_first(),
        *[F.asc_nulls_first(c) for c in ("reptstate", "ui", "report")],
    ]


def numbered(rows: DataFrame, root: str | None = None) -> DataFrame:
    """Report or unit rows with their place in the display order of their selection."""
    order = [*display_order(), *([F.col("is_knr")] if "is_knr" in rows.columns else [])]
    return with_rank(rows, order, SELECTION, "row_index", root=root)


def ui_rollup(detail: DataFrame, link_base: str = "") -> DataFrame:
    """Reports added up per unit, flag and knr mark.

    Fields the reports disagree on are left blank, comment codes are united and
    the NAICS code is cut to what all share.  Only sums, extremes and small sets
    are kept per group, so they combine before the shuffle.
    """
    blank, missing = F.lit(""), F.lit(None)
    texts = ("report", "reptw", "pm_flag", "origflag", "prior_flag")
    numbers = ("selsize", "weight", "pm_dwght", "origdwght", "dwght", "drr")
    keys = [*SELECTION, *UNIT_GROUP]
    # Texts make Spark sort what it adds up; a hash before the keys decides most comparisons.
    groups = detail.groupBy(F.xxhash64(*keys).alias("spread"), *keys).agg(
        F.count(F.lit(1)).alias("detail_count"),
        *[N.sum_or_zero(F.col(c)).alias(c) for c in ("pm", "cm", "wpm", "wcm", "otm", "wotm")],
        *[C.merged_code_lists(F.col(c)).alias(c) for c in ("pmcc", "cmcc")],
        *[N.agreed_value(F.col(c), blank).alias(c) for c in texts],
        *[N.agreed_value(F.col(c), missing).alias(c) for c in numbers],
        F.min("naics").alias("naics_min"),
        F.max("naics").alias("naics_max"),
    )
    several = F.col("detail_count") > 1
    row_type = F.when(several, "summary").otherwise("single")
    return (
        groups.withColumns({"pm_size": size_bracket(F.col("pm")), "cm_size": size_bracket(F.col("cm"))})
        .filter(F.col("pm_size").isNotNull() & F.col("cm_size").isNotNull())
        .withColumns({
            "szgap": size_gap(F.col("pm_size"), F.col("cm_size"), F.col("selsize")),
            "naics": C.common_prefix(F.col("naics_min"), F.col("naics_max")),
            "report": F.when(several, F.col("reptw")).otherwise(F.col("report")),
            "is_summed": several,
            "row_type": row_type,
        })
        .withColumns({"history_url": _history_link(F.col("row_type")), **_unit_links(link_base)})
        .drop("spread", "naics_min", "naics_max")
    )


def review_shortlist(rollup: DataFrame, k: int = 31) -> DataFrame:
    """The first k unit rows of every selection, plus every row with flag X or a
    changed flag, each with the selection's row count.

    A selection may hold any share of all rows, so its rows are ranked in as
    many parts as there are shuffle partitions.  Only the first k of each part
    meet in one place, where the k-th row of the selection is found; rows are
    then kept by comparing with it.
    """
    parts = int(rollup.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(
        F.col("flag"), (-F.abs(F.col("wotm"))).alias("change"),
        *[F.col(c) for c in ("reptstate", "ui", "report", "is_knr")],
    )
    part = F.pmod(F.xxhash64(*UNIT_GROUP), F.lit(parts))
    in_part = Window.partitionBy(*SELECTION, "part")
    in_selection = Window.partitionBy(*SELECTION)
    limits = (
        rollup.select(*SELECTION, place.alias("place"), part.alias("part"))
        .withColumns({
            "part_rank": F.row_number().over(in_part.orderBy("place")),
            "part_rows": F.count(F.lit(1)).over(in_part),
        })
        .filter(F.col("part_rank") <= k)
        .withColumns({
            "rank": F.row_number().over(in_selection.orderBy("place")),
            "total_rows": F.sum(F.when(F.col("part_rank") == 1, F.col("part_rows"))).over(in_selection),
        })
        .filter(F.col("rank") <= k)
        .groupBy(*SELECTION)
        .agg(F.max("place").alias("last_place"), F.max("total_rows").alias("total_rows"))
    )
    return (
        rollup.join(limits, list(SELECTION))
        .filter(
            (place <= F.col("last_place")) | (F.col("flag") == "X")
            | (F.col("flag") != F.col("origflag"))
        )
        .drop("last_place")
    )


def group_detail(detail: DataFrame, groups: DataFrame) -> DataFrame:
    """Report rows behind the given unit rows."""
    keys = [*SELECTION, *UNIT_GROUP]
    return detail.join(groups.select(*keys).distinct(), keys, "left_semi")


def review_flags(detail: DataFrame) -> DataFrame:
    """Marks a reviewer sees on each row: changed flags, weights and direction."""
    c = F.col

    def differs(left, right):
        return ~c(left).eqNullSafe(c(right))

    reweighted = (
        differs("dwght", "origdwght") & (F.coalesce(c("origdwght") != 0, F.lit(True)))
        & ~differs("flag", "origflag") & F.coalesce(c("flag") == "T", F.lit(False))
    )
    change = N.to_long(c("wotm"))
    return detail.withColumns({
        "flag_changed": differs("flag", "origflag"),
        "allowed_flags": F.when(c("flag").isin("A", "T"), "A,T,X").otherwise(c("flag")),
        "dwght_changed": reweighted,
        "pm_flag_differs": differs("pm_flag", "flag"),
        "prior_flag_differs": differs("prior_flag", "flag"),
        "direction": F.when(change > 0, "up").when(change < 0, "down").otherwise(""),
    })
