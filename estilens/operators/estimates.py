"""Estimates: adjustments, history, period panel, changes and tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from estilens.functions import codes as C
from estilens.functions import comments
from estilens.functions import months as M
from estilens.functions import numbers as N
from estilens.keys import ALL_EMPLOYEES, AREA_SERIES, PERIOD, REQUEST, SERIES, SERVICE_SECTOR, VIEW, keyed
from estilens.operators import periods as P

# Datatypes whose tolerances are rounded to hundreds.
ROUNDED_DATATYPES = ("01", "85", "06")


def adjustment_decomposition(estimates: DataFrame) -> DataFrame:
    """Split the way from original to published estimate into its parts."""
    c = F.col
    treatment = (c("recalc_estimate_value") - c("original_estimate_value")
                 - c("sample_adjustment") - c("non_sample_adjustment"))
    return estimates.withColumns({
        "estimate_adjustment": N.rounded_long(c("sample_adjustment")),
        "nse": N.rounded_long(c("non_sample_adjustment")),
        "sample_treatment": N.rounded_long(treatment),
        "ratio_adjustment": N.rounded_long(c("published_estimate_value") - c("recalc_estimate_value")),
    })


def parse_adjustment_comments(estimates: DataFrame) -> DataFrame:
    """Type, amount, subtype and reason from the comment, and a short label."""
    parts = comments.adjustment_parts(F.col("analyst_comment"))
    label = comments.adjustment_label(
        F.col("adjtype"), F.col("adjamt"), F.col("adjsubtype"), F.col("adjreason"),
        F.col("sample_adjustment"),
    )
    return estimates.withColumns(parts).withColumn("est_adj", label)


def series_history(estimates: DataFrame, months: int = 27, releases: DataFrame | None = None) -> DataFrame:
    """The last months of every all-employee series at each month's newest closing.

    With releases, there is a history for each of them, keyed by sel_year,
    sel_month and sel_closing: three calendar years up to the year of the release,
    and nothing released for a later month or closing.  Without, there is one per
    series that ends with its latest year.

    The newest closing is taken over all datatypes before anything is filtered.
    One exchange on the series (and release) serves every window; such a group has
    at most a row per month, closing and datatype of three years.
    """
    group = list(AREA_SERIES)
    if releases is not None:
        group += ["sel_year", "sel_month", "sel_closing"]
        asked = releases.select(
            *keyed(releases), *[F.col(c).alias(s) for c, s in zip(PERIOD, group[-3:])],
            F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda n: (F.col("year").cast("bigint") - n).cast("string"))).alias("row_year"),
        ).withColumnRenamed("row_year", "year")
        # A release meets the rows of its three years; the table of releases follows the calendar.
        estimates = estimates.join(asked, keyed(asked, "year")).filter(
            M.release_code(F.col("year"), F.col("month"), F.col("estimate_type_code"))
            <= M.release_code(F.col("sel_year"), F.col("sel_month"), F.col("sel_closing"))
        )
    by_month = Window.partitionBy(*group, "year", "month")
    by_series = Window.partitionBy(*group)
    in_order = by_series.orderBy("year", "month")
    last_year = F.col("sel_year") if releases is not None else F.max("year").over(by_series)

    rows = (
        adjustment_decomposition(estimates)
        .repartition(*group)
        .withColumn("newest", F.max("estimate_type_code").over(by_month))
        .withColumn("last_year", last_year)
        .filter(
            (F.col("data_type_code") == ALL_EMPLOYEES)
            & (F.col("estimate_type_code") == F.col("newest"))
            & (F.col("year").cast("bigint") > F.col("last_year").cast("bigint") - 3)
        )
        .withColumns({
            "before": F.lag("published_estimate_value").over(in_order),
            "position": F.row_number().over(in_order),
            "held": F.count(F.lit(1)).over(by_series),
        })
        .filter(F.col("held") - F.col("position") < months)
    )
    return parse_adjustment_comments(rows).select(
        *group, "year", "month",
        F.col("estimate_type_code").alias("closing"),
        "published_estimate_value", "upper_tolerance", "lower_tolerance",
        "adjtype", "adjsubtype", "adjamt", "adjreason", "est_adj",
        N.to_long(F.col("original_estimate_value")).alias("orig_est"),
        F.col("estimate_adjustment").alias("est_adj_value"),
        "nse",
        F.col("sample_treatment").alias("sample_adj"),
        F.col("ratio_adjustment").alias("ratio_adj"),
        F.col("analyst_comment").alias("est_adj_cmnt"),
        N.to_long(F.col("published_estimate_value")).alias("rvalue"),
        N.to_long(F.col("upper_tolerance") * F.col("before")).alias("hitol"),
        N.to_long(F.col("lower_tolerance") * F.col("before")).alias("lotol"),
    )


def year_ago_values(estimates: DataFrame) -> DataFrame:
    """All-employee value of every month at its newest closing over all datatypes."""
    own = F.when(
        F.col("data_type_code") == ALL_EMPLOYEES,
        F.struct("estimate_type_code", N.to_long(F.col("published_estimate_value")).alias("value")),
    )
    return (
        estimates.groupBy(*keyed(estimates, *AREA_SERIES), "year", "month")
        .agg(F.max("estimate_type_code").alias("newest"), F.max(own).alias("own"))
        .filter(F.col("own.estimate_type_code") == F.col("newest"))
        .select(*keyed(estimates, *AREA_SERIES), "year", "month", F.col("own.value").cast("double").alias("py"))
    )


def inherit_tolerance(estimates: DataFrame) -> DataFrame:
    """Service-sector rows take the tolerances of the all-employee row beside them."""
    beside = Window.partitionBy(*keyed(estimates, *AREA_SERIES), "year", "month", "estimate_type_code")

    def tolerance(name: str) -> Column:
        employees = F.max(F.when(F.col("data_type_code") == ALL_EMPLOYEES, F.col(name))).over(beside)
        return F.when(F.col("data_type_code") == SERVICE_SECTOR, employees).otherwise(F.col(name))

    return estimates.withColumns({n: tolerance(n) for n in ("upper_tolerance", "lower_tolerance")})


def period_panel(estimates: DataFrame, structure: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of each request: its own month, the month before and the year before.

    requests comes from release_requests, and has a view if the estimates have
    one.  It follows the calendar, so Spark sends it to the executors and the
    estimates are not moved; structure (whose benchmark year is deliberately not
    a key) goes where its size says as well.
    """
    kinds = structure.select(*SERIES, "series_type_code", "ws_flag").distinct()
    wanted = requests.select(*keyed(requests, *REQUEST), "role", "p12m_y",
                             F.col("row_year").alias("year"), F.col("row_month").alias("month"),
                             F.col("row_closing").alias("estimate_type_code"))
    return estimates.join(
        wanted, keyed(estimates, *PERIOD)
    ).join(kinds, list(SERIES))


def backfill_ess(panel: DataFrame) -> DataFrame:
    """Give service-sector series the all-employee prior month and year ago.

    Those copies and every row outside the current month lose their original
    and recalculated values.  A row equal to a copy is kept once.
    """
    current = F.col("role") == "cm"
    copied = (F.col("data_type_code") == ALL_EMPLOYEES) & ~current
    own = F.struct(F.col("data_type_code").alias("dt"), F.lit(False).alias("backfilled"))
    copy = F.struct(F.lit(SERVICE_SECTOR).alias("dt"), F.lit(True).alias("backfilled"))
    rows = panel.withColumns({
        "original_estimate_value": F.when(current, F.col("original_estimate_value")),
        "recalc_estimate_value": F.when(current, F.col("recalc_estimate_value")),
        "t": F.explode(F.when(copied, F.array(own, copy)).otherwise(F.array(own))),
    }).withColumns({"data_type_code": F.col("t.dt"), "backfilled": F.col("t.backfilled")}).drop("t")
    columns = [c for c in rows.columns if c != "backfilled"]
    return (
        rows.repartition(*SERIES, *REQUEST)
        .groupBy(*columns)
        .agg(F.max("backfilled").alias("backfilled"))
    )


def _in_request() -> WindowSpec:
    """Window over the few rows of one series in one request, oldest first.

    Where a service-sector row and a copied row share a month, the copy is last.
    """
    keys = Window.partitionBy(*SERIES, "series_type_code", *REQUEST)
    return keys.orderBy("year", "month", "backfilled")


def change_metrics(panel: DataFrame, year_ago: DataFrame) -> DataFrame:
    """Over-the-month and over-the-year changes of the current-month rows.

    The prior month is the row before the current one in the panel; the year
    ago is one all-employee value per series, whatever the datatype.
    """
    before = F.lag("published_estimate_value").over(_in_request())
    past = year_ago.withColumnRenamed("year", "p12m_y")
    rows = (
        panel.withColumn("pm", before)
        .filter(F.col("role") == "cm")
        .join(past, [*keyed(past, *AREA_SERIES), "p12m_y", "month"], "left")
        .withColumn("cm", F.col("published_estimate_value"))
    )
    values = {"": "cm", "orig_": "original_estimate_value", "recalc_": "recalc_estimate_value"}
    return rows.withColumns({
        f"{name}{change}_change": F.col(value) - F.col(base)
        for name, value in values.items()
        for change, base in (("oty", "py"), ("otm", "pm"))
    })


def estimate_info(panel: DataFrame, year_ago: DataFrame) -> DataFrame:
    """Current-month rows with changes, prior comment, tolerances and the
    out-of-tolerance mark (H, L or empty).

    panel is the result of period_panel on estimates that went through
    adjustment_decomposition and inherit_tolerance.
    """
    own_comment = F.when(~F.col("backfilled"), F.struct("analyst_comment"))
    earlier = _in_request().rowsBetween(Window.unboundedPreceding, -1)
    with_comment = backfill_ess(panel).withColumn(
        "pm_comment", F.last(own_comment, ignorenulls=True).over(earlier)["analyst_comment"]
    )

    def tolerance(name: str) -> Column:
        value = F.col(name) * F.col("pm")
        rounded = F.col("data_type_code").isin(*ROUNDED_DATATYPES)
        return F.when(rounded, N.nearest_hundred(value)).otherwise(value)

    return (
        change_metrics(with_comment, year_ago)
        .withColumns({
            "hi_tolerance": tolerance("upper_tolerance"),
            "lo_tolerance": tolerance("lower_tolerance"),
        })
        .withColumn(
            "oot",
            F.when(F.col("cm") > F.col("hi_tolerance"), "H")
            .when(F.col("cm") < F.col("lo_tolerance"), "L")
            .otherwise(""),
        )
        .drop("role", "backfilled", "p12m_y")
    )


def review_estimates(estimates: DataFrame, structure: DataFrame, periods: DataFrame) -> DataFrame:
    """estimate_info for the requested releases and the closings before them."""
    requests = P.release_requests(periods)
    sources = requests.select(
        *keyed(requests), F.col("row_year").alias("year"), F.col("row_month").alias("month"),
        F.col("row_closing").alias("estimate_type_code"))
    # Drop unneeded months before the tolerance window moves any row.
    raw = adjustment_decomposition(inherit_tolerance(P.on_periods(estimates, sources)))
    past_months = requests.select(*keyed(requests), F.col("p12m_y").alias("year"), F.col("sel_month").alias("month")).distinct()
    past = estimates.join(past_months, keyed(estimates, "year", "month"), "left_semi")
    return estimate_info(period_panel(raw, structure, requests), year_ago_values(past))


# Display order of the comparison rows.
COMPARISON_ORDER = ("pub", "hi-tol", "lo-tol", "recalc", "orig", "p-pub", "p-recalc", "p-orig")

_COMPARED = (*SERIES, "series_type_code", *REQUEST)


def estimate_comparison(info: DataFrame) -> DataFrame:
    """Published, tolerance, recalculated and original rows of each request.

    Rows of the prior closing are named p-... and have no tolerance rows.
    Percentages divide by the prior month.  crossed marks the tolerance row that
    the published estimate has crossed.  Every input row unfolds in place, so
    nothing is shuffled.
    """
    asked = F.col("this_closing") == F.col("sel_closing")
    pm = N.to_long(F.col("pm"))
    empty = F.lit(None).cast("bigint")

    published = F.coalesce(N.to_long(F.col("cm")), F.lit(0))

    def row(version, est, pm_shown, otm=empty, oty=empty, crossed=F.lit(False)):
        name = F.when(asked, version).otherwise(f"p-{version}")
        return F.struct(
            name.alias("version"), est.alias("est"), pm_shown.alias("pm"),
            otm.alias("otm"), oty.alias("oty"),
            N.ratio(otm, pm).alias("otm_pct"), N.ratio(oty, pm).alias("oty_pct"),
            crossed.alias("crossed"),
        )

    def bound(version, name, passed):
        value = N.to_long(F.col(name))
        return row(version, value, empty, crossed=passed(published, F.coalesce(value, F.lit(0))))

    def measured(version, value, prefix, pm_shown):
        cut = {c: N.to_long(F.col(c)) for c in (value, f"{prefix}otm_change", f"{prefix}oty_change")}
        return row(version, cut[value], pm_shown, cut[f"{prefix}otm_change"], cut[f"{prefix}oty_change"])

    versions = [
        measured("pub", "cm", "", pm),
        measured("recalc", "recalc_estimate_value", "recalc_", empty),
        measured("orig", "original_estimate_value", "orig_", empty),
    ]
    bounds = [
        bound("hi-tol", "hi_tolerance", lambda value, limit: value > limit),
        bound("lo-tol", "lo_tolerance", lambda value, limit: value < limit),
    ]
    rows = F.when(asked, F.array(*versions, *bounds)).otherwise(F.array(*versions))
    order = F.array_position(F.array(*[F.lit(v) for v in COMPARISON_ORDER]), F.col("v.version"))
    return (
        info.select(*_COMPARED, F.explode(rows).alias("v"))
        .select(*_COMPARED, order.alias("row_order"), "v.*")
    )


# Short names of datatypes and closings.
DATATYPE_NAMES = {"01": "AE", "85": "ESS"}
CLOSING_NAMES = {"1": "P", "2": "F", "3": "R"}


def _named(code: Column, names: dict[str, str], otherwise: Column) -> Column:
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.coalesce(F.create_map(*pairs)[code], otherwise)


def series_info(info: DataFrame, link_base: str = "") -> DataFrame:
    """Header rows: selection label, types, verifiers, adjustments and link."""
    c = F.col
    state, area = C.zero_pad(c("state_fips_code"), 2), C.zero_pad(c("area_fips_code"), 5)
    series, month = C.zero_pad(c("series_code"), 8), C.zero_pad(c("sel_month"), 2)
    label = F.concat_ws(
        "-", state, area, series,
        _named(c("data_type_code"), DATATYPE_NAMES, c("data_type_code")),
        c("sel_year"), month,
        _named(c("sel_closing"), CLOSING_NAMES, c("sel_closing")),
    )
    query = F.concat_ws(
        ";", state, M.benchmark_year(c("sel_year"), c("sel_closing")), area, series,
        c("sel_year"), month, c("sel_closing"), c("data_type_code"), F.lit("0'"),
    )
    return info.select(
        *SERIES, *REQUEST,
        label.alias("series"),
        c("series_type_code").alias("stc"),
        c("estimation_type_code").alias("estimator"),
        c("birth_death_factor").alias("bdf"),
        c("ws_flag").alias("ws"),
        C.verifier_name(c("state_verified_by")).alias("junior"),
        C.verifier_name(c("ro_verified_by")).alias("senior"),
        _named(c("estimate_type_code"), CLOSING_NAMES, F.lit("")).alias("pfr"),
        c("sample_treatment").alias("sample_adj"),
        c("estimate_adjustment").alias("est_adj"),
        c("analyst_comment").alias("adj_comment"),
        "nse",
        c("ratio_adjustment").alias("ratio_adj"),
        F.concat(F.lit(f"{link_base}?q="), query).alias("link"),
    )


def _history_group(history: DataFrame) -> list[str]:
    """What one history is about: a series, looked at from a release if there are several."""
    return [*AREA_SERIES, *[c for c in ("sel_year", "sel_month", "sel_closing") if c in history.columns]]


def line_split(history: DataFrame) -> DataFrame:
    """Benchmark (closing 4) and estimate lines of each series' history.

    The benchmark point right before the first estimate also belongs to the
    estimate line, to join the two.  Windows hold one series' last months.
    """
    benchmark = F.when(F.col("closing") == "4", F.col("rvalue"))
    estimate = F.when(F.col("closing") != "4", F.col("rvalue"))
    group = _history_group(history)
    in_order = Window.partitionBy(*group).orderBy(F.col("year").cast("int"), F.col("month").cast("int"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bridge = (F.count(estimate).over(so_far) == 0) & F.lead(estimate).over(in_order).isNotNull()
    return history.select(
        *group, "year", "month",
        M.month_year_label(F.col("year"), F.col("month")).alias("label"),
        benchmark.alias("benchmark"),
        F.when(bridge, benchmark).otherwise(estimate).alias("estimate"),
        "lotol", "hitol",
    )


# Row titles of the history table and the columns they show.
HISTORY_MEASURES = {
    "Orig Est": "orig_est", "Sample Adj": "sample_adj", "NSE": "nse",
    "Est Adj": "est_adj", "Ratio Adj": "ratio_adj", "Pub Est": "rvalue",
}


def history_matrix(history: DataFrame, months: int = 18, with_place: bool = False) -> DataFrame:
    """Six measures by month in long form, without measures that are all zero.

    Values are text because the estimate adjustment may be a label.  Original
    and published estimates carry their change from the month before.  with_place
    adds back: 1 for the newest month of the history, 2 for the one before it.
    """
    group = _history_group(history)
    by_series = Window.partitionBy(*group)
    in_order = by_series.orderBy(F.col("year").cast("int"), F.col("month").cast("int"))
    measures = F.explode(F.array(*[
        F.struct(F.lit(title).alias("rowtitle"), F.col(name).cast("string").alias("value"))
        for title, name in HISTORY_MEASURES.items()
    ]))
    by_measure = Window.partitionBy(*group, "rowtitle")
    number = F.coalesce(F.col("value").try_cast("bigint"), F.lit(0))
    shown = ~F.coalesce(F.col("value"), F.lit("")).isin("0", "0.0")
    before = F.lag(number).over(by_measure.orderBy("position"))
    return (
        history.repartition(*group)
        .withColumns({
            "position": F.row_number().over(in_order),
            "held": F.count(F.lit(1)).over(by_series),
        })
        .filter(F.col("held") - F.col("position") < months)
        .withColumn("m", measures)
        .select(*group, "year", "month", "position", (F.col("held") - F.col("position") + 1).alias("back"), "m.*")
        .withColumn("any_shown", F.max(shown).over(by_measure))
        .withColumn("before", before)
        .filter("any_shown")
        .select(
            *group, "rowtitle", "year", "month",
            F.concat(M.month_name(F.col("month")), F.lit("-"), M.short_year(F.col("year"))).alias("label"),
            "value",
            F.when(
                F.col("rowtitle").isin("Orig Est", "Pub Est") & F.col("before").isNotNull() & (number != 0),
                number - F.col("before"),
            ).alias("change"),
            *(["back"] if with_place else []),
        )
    )


def history_by_position(history: DataFrame, months: int = 18) -> DataFrame:
    """The history table with months as columns, counted back from the newest one.

    m01 is the newest month of a history, m02 the one before it; month_labels names
    them in that order.  Columns do not depend on the data, so histories of any
    releases, with their own months each, stand in one table.  Two values for one
    cell are an error.
    """
    matrix = history_matrix(history, months, with_place=True)
    names = {k: f"m{k:02d}" for k in range(1, months + 1)}

    def cell(k: int, column: str) -> Column:
        return F.max(F.when(F.col("back") == k, F.col(column)))

    twice = F.count(F.lit(1)) > F.count_distinct("back")
    # One sort key and value per month, put in order once the group is complete.
    labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("back", "label"))), lambda x: x["label"]), ",")
    return (
        matrix.groupBy(*_history_group(matrix), "rowtitle")
        .agg(
            F.when(twice, F.raise_error(F.lit("a month occurs twice in a history"))).otherwise(labels).alias("month_labels"),
            *[cell(k, "value").alias(name) for k, name in names.items()],
        )
    )


def history_labels(year: int) -> list[str]:
    """The months that histories ending in a year can show: those of that year and
    of the year before."""
    return [f"{name}-{y % 100:02d}" for y in (year - 1, year) for name in M.MONTH_NAMES]


def history_table(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """The same table with months as columns; the months are given, not searched for.

    A month of the matrix that is not among them is an error, as are two values for
    one cell.  history_by_position needs no months.
    """
    unknown = F.raise_error(F.concat(F.lit("a history has a month that no column was given for: "), F.col("label")))
    matrix = matrix.withColumn("label", F.when(F.col("label").isin(labels), F.col("label")).otherwise(unknown))
    twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a month occurs twice in a history")).cast("string"))
    return (
        matrix.groupBy(*_history_group(matrix), "rowtitle")
        .pivot("label", labels)
        .agg(F.coalesce(twice, F.max("value")))
    )
