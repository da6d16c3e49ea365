from pyspark.sql import functions as F

from estilens.keys import PERIOD, SERIES
from estilens.operators import catalog, estimates, history, models, navigation, periods

ESTIMATES = (
    ", ".join(f"{c} string" for c in (*SERIES, *PERIOD))
    + ", estimation_type_code string, published_estimate_value double, recalc_estimate_value double, "
    "original_estimate_value double, sample_adjustment double, non_sample_adjustment double, "
    "upper_tolerance double, lower_tolerance double, birth_death_factor double, analyst_comment string, "
    "state_verified_by string, ro_verified_by string"
)
KS = ("01", "00000", "10000000")


def row(year, month, closing, value, datatype="01", comment=None, tolerances=(1.1, 0.9)):
    if datatype == "85":
        tolerances = (None, None)
    return (*KS, datatype, year, month, closing, "S", value, value - 1, value - 3, 1.0, 0.0,
            *tolerances, 1.0, comment, "jane.doe@x", None)


def structure(spark, *datatypes):
    return spark.createDataFrame(
        [(*KS, d, "B", "Yes") for d in datatypes],
        ", ".join(f"{c} string" for c in SERIES) + ", series_type_code string, ws_flag string")


def asked(spark, *releases):
    return spark.createDataFrame(list(releases), ", ".join(f"{c} string" for c in PERIOD))


def info(spark, rows, *releases, datatypes=("01", "85")):
    frame = spark.createDataFrame(rows, ESTIMATES)
    got = estimates.review_estimates(frame, structure(spark, *datatypes), asked(spark, *releases))
    return {(r.data_type_code, r.this_closing): r for r in got.collect()}


def test_current_row_takes_prior_month_and_year_ago(spark):
    rows = [row("2020", "07", "4", 800.0), row("2021", "06", "2", 1000.0, comment="before"), row("2021", "07", "2", 1200.0)]
    got = info(spark, rows, ("2021", "07", "2"))[("01", "2")]
    assert (got.pm, got.py, got.otm_change, got.oty_change) == (1000.0, 800.0, 200.0, 400.0)
    assert (got.hi_tolerance, got.lo_tolerance, got.oot, got.pm_comment) == (1100.0, 900.0, "H", "before")


def test_without_prior_month_the_row_before_is_used(spark):
    rows = [row("2020", "07", "4", 800.0), row("2021", "07", "2", 1200.0)]
    assert info(spark, rows, ("2021", "07", "2"))[("01", "2")].pm == 800.0


def test_ess_uses_the_all_employee_prior_month_and_tolerance(spark):
    rows = [row("2021", "06", "2", 1000.0), row("2021", "06", "2", 700.0, "85"),
            row("2021", "07", "2", 1200.0), row("2021", "07", "2", 750.0, "85")]
    got = info(spark, rows, ("2021", "07", "2"))[("85", "2")]
    assert (got.pm, got.hi_tolerance, got.oot) == (1000.0, 1100.0, "L")


def test_prior_closing_comes_along(spark):
    rows = [row("2021", "06", "2", 1000.0), row("2021", "07", "1", 1150.0), row("2021", "07", "2", 1200.0)]
    got = info(spark, rows, ("2021", "07", "2"), datatypes=("01",))
    assert set(got) == {("01", "1"), ("01", "2")}
    assert got[("01", "1")].otm_change == 150.0


def test_comparison_and_crossing(spark):
    rows = [row("2021", "06", "2", 1000.0), row("2021", "07", "1", 1150.0), row("2021", "07", "2", 1200.0)]
    frame = spark.createDataFrame(rows, ESTIMATES)
    i = estimates.review_estimates(frame, structure(spark, "01"), asked(spark, ("2021", "07", "2")))
    got = estimates.estimate_comparison(i).orderBy("row_order").collect()
    assert [r.version for r in got] == ["pub", "hi-tol", "lo-tol", "recalc", "orig", "p-pub", "p-recalc", "p-orig"]
    assert [r.version for r in got if r.crossed] == ["hi-tol"]
    assert got[0].otm_pct == 0.2 and got[3].pm is None


def test_history_drops_months_whose_newest_closing_lacks_all_employees(spark):
    rows = [row("2021", f"{m:02d}", "2", 100.0 * m) for m in range(1, 7)]
    rows.append(row("2021", "06", "3", 1.0, "85"))
    got = estimates.series_history(spark.createDataFrame(rows, ESTIMATES)).orderBy("month").collect()
    assert [r.month for r in got] == ["01", "02", "03", "04", "05"]
    assert got[0].hitol is None and got[1].hitol == 110


def test_history_keeps_the_last_months(spark):
    rows = [row(y, f"{m:02d}", "2", 1.0) for y in ("2019", "2020", "2021") for m in range(1, 13)]
    got = estimates.series_history(spark.createDataFrame(rows, ESTIMATES))
    assert got.count() == 27 and got.agg(F.min(F.concat("year", "month"))).first()[0] == "201910"


def test_line_split_bridges_once(spark):
    closings = ["4", "4", "2", "4", "2"]
    rows = [row("2021", f"{m:02d}", c, 10.0 * m) for m, c in enumerate(closings, 1)]
    lines = estimates.line_split(estimates.series_history(spark.createDataFrame(rows, ESTIMATES)))
    got = [(r.benchmark, r.estimate) for r in lines.orderBy("month").collect()]
    assert got == [(10, None), (20, 20), (None, 30), (40, None), (None, 50)]


def test_history_matrix_drops_zero_measures(spark):
    rows = [row("2021", f"{m:02d}", "2", 10.0 * m) for m in range(1, 4)]
    got = estimates.history_matrix(estimates.series_history(spark.createDataFrame(rows, ESTIMATES))).collect()
    assert {r.rowtitle for r in got} == {"Orig Est", "Sample Adj", "Est Adj", "Ratio Adj", "Pub Est"}
    assert [r.change for r in sorted(got, key=lambda r: r.month) if r.rowtitle == "Pub Est"] == [None, 10, 10]


def test_small_domain_weights_follow_ownership_and_comment(spark):
    keys = ", ".join(f"{c} string" for c in (*SERIES, *PERIOD))
    model = spark.createDataFrame(
        [("01", "40001", s, "01", "2021", "07", "2", 0.2, 0.3, 0.5, 1.1, 1.2, 1.3) for s in ("10000000", "90910000")],
        keys + ", weight_y1 double, weight_y2 double, weight_y4 double, link_y1 double, link_y2 double, link_y4 double")
    i = spark.createDataFrame(
        [("01", "40001", s, "01", "2021", "07", "2", "2", "2", "S", "was Adjusted to Y1 link", 105.0)
         for s in ("10000000", "90910000")],
        keys + ", this_closing string, sel_closing string, estimation_type_code string, analyst_comment string, pm double")
    got = {(r.series_code, r.estimator): r for r in models.small_domain_model(model, i).collect()}
    assert got[("10000000", "y4")].weight == 0.5 and got[("10000000", "y1")].weight == 0.2
    assert (got[("90910000", "y1")].weight, got[("90910000", "y2")].weight) == (1.0, 0.0)
    assert ("90910000", "y4") not in got
    assert (got[("10000000", "y1")].estimate, got[("10000000", "y1")].otm) == (115, 10)


def test_latest_release_needs_the_newest_year(spark):
    schema = "s string, year string, month string, estimate_type_code string"
    rows = [("a", "2020", "12", "3"), ("a", "2021", "02", "1"), ("a", "2021", "02", "2"), ("b", "2021", "05", "1")]
    frame = spark.createDataFrame(rows, schema)
    assert tuple(periods.latest_release(frame, {"s": "a"}).first()) == ("2021", "02", "2")
    assert periods.latest_release(frame.union(spark.createDataFrame([("b", "2022", "01", "1")], schema)), {"s": "a"}).count() == 0


def test_calendar(spark):
    last = spark.createDataFrame([("2021", "02", "1")], "year string, month string, closing string")
    got = {(r.year, r.month, r.closing) for r in periods.release_calendar(last, 2019).collect()}
    assert ("2021", "02", "1") in got and ("2021", "02", "2") not in got and ("2021", "03", "1") not in got
    assert ("2020", "12", "3") in got and ("2020", "12", "2") not in got and ("2020", "09", "3") not in got


def test_vintages(spark):
    available = spark.createDataFrame([("2019",), ("2020",), ("current",)], "vintage string")

    def needed(*release):
        return {r.vintage for r in periods.vintages_needed(asked(spark, release), available).collect() if r.held}

    assert needed("2021", "06", "2") == {"2020"}
    assert needed("2021", "06", "3") == {"current"}
    assert needed("2020", "11", "3") == {"2020", "2019"}


def test_closest_code(spark):
    options = spark.createDataFrame([("g", c) for c in ("10", "20237", "20238", "32100", "41", "43")], "k string, option string")
    codes = ["20238", "20239", "3", "31", "43000", "99", "", None, "2"]
    requests = spark.createDataFrame([("g", c) for c in codes], "k string, code string")
    got = {r.code: r.chosen for r in navigation.closest_code(requests, options, ["k"]).collect()}
    assert got["20238"] == "20238" and got["20239"] == "20237" and got["2"] == "20237"
    assert got["3"] == "32100" and got["31"] == "32100" and got["43000"] == "41"
    assert got["99"] == got[""] == got[None] == "10"


def test_navigation_spills_into_the_next_area(spark):
    rows = [("01", "a", "1", "01"), ("01", "a", "2", "85"), ("01", "a", "2", "01"), ("01", "b", "1", "01"), ("02", "c", "1", "01")]
    frame = spark.createDataFrame(rows, "state string, area string, series string, datatype string")
    got = {(r.area, r.series): r for r in navigation.series_navigation(frame).collect()}
    assert (got[("a", "2")].next_series_area, got[("a", "2")].next_series) == ("b", "1")
    assert (got[("b", "1")].prev_series, got[("b", "1")].prev_series_datatype) == ("2", "85")
    assert got[("a", "1")].next_area == "b" and got[("c", "1")].prev_series is None


def test_select_rows_skips_blank_and_unknown(spark):
    frame = spark.createDataFrame([("a", "1"), ("b", "2")], "x string, y string")
    assert catalog.select_rows(frame, {"x": "a", "y": "", "z": "9", "w": None}).count() == 1


def test_month_segments_have_no_gaps(spark):
    keys = [*SERIES, *history.CURRENT, "reptstate", "ui", "cm_flag"]
    rows = [(*["k"] * len(keys), True, False, "2020", "12", 5.0, 6.0, "red"), (*["k"] * len(keys), True, False, "2021", "03", 7.0, 8.0, "blue"),
            (*["k"] * len(keys), True, False, "2021", "04", 0.0, 8.0, "blue")]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in keys)
                                  + ", cm_knr boolean, is_knr boolean, year string, month string, pm double, cm double, colour string")
    got = history.month_segments(frame, "summary").orderBy("axis_year", "axis_month").collect()
    assert [(r.axis_label, r.segment, r["value"], r.colour) for r in got] == [
        ("Nov 2020", "Dec'20", 5.0, "red"), ("Dec 2020", "Dec'20", 6.0, "red"), ("Jan 2021", None, None, None),
        ("Feb 2021", "Mar'21", 7.0, "blue"), ("Mar 2021", "Mar'21", 8.0, "blue")]
