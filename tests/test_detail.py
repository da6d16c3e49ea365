import random

from pyspark.sql import functions as F

from estilens.keys import SELECTION, UNIT_GROUP
from estilens.operators import detail as D
from estilens.operators import whatif
from estilens.operators.sample import flag_summary, sample_summary, weighted_sample

SAMPLE = (
    "state_fips_code string, area_fips_code string, series_code string, data_type_code string, year string, "
    "month string, estimate_type_code string, report_id string, rept_sfc string, selected_ui_number string, "
    "report_with string, naics_code string, selection_size string, sample_weight double, diff_resp_rate double, "
    "cont_tot_dwnwght double, original_cont_tot_dwnwght double, pm_value bigint, cm_value bigint, a_typ_flag string, "
    "original_a_typ_flag string, pm_comment_1 string, pm_comment_2 string, cm_comment_1 string, cm_comment_2 string, "
    "version string"
)


def report(year="2021", month="07", closing="2", rept="0000001", ui="U1", reptw="W1", flag="T", origflag="T",
           pm=10, cm=12, weight=2.0, down=1.0, naics="561110", selsize="1", codes=(None, None, None, None)):
    return ("01", "00000", "10000000", "01", year, month, closing, rept, "01", ui, reptw, naics, selsize,
            weight, 1.0, down, 1.0, pm, cm, flag, origflag, *codes, "1")


def weighted(spark, rows):
    return weighted_sample(spark.createDataFrame(rows, SAMPLE))


def test_look_back_follows_the_release_rules(spark):
    rows = [
        report(month="06", closing="2", flag="A", down=0.5),  # prior month of closings 1 and 2
        report(month="06", closing="4", flag="X"),            # prior month of closing 3
        report(month="07", closing="1", flag="U"),
        report(month="07", closing="2", flag="T"),
        report(month="07", closing="3", flag="A"),
    ]
    got = {(r.month, r.estimate_type_code): (r.pm_flag, r.pm_dwght, r.prior_flag)
           for r in D.sample_detail(weighted(spark, rows)).collect()}
    assert got[("07", "1")] == ("A", 0.5, None)
    assert got[("07", "2")] == ("A", 0.5, "U")
    assert got[("07", "3")] == ("X", 1.0, "T")


def test_january_and_december(spark):
    rows = [
        report("2020", "12", "3", flag="A"), report("2020", "12", "1", flag="U"),
        report("2020", "11", "3", flag="X"), report("2021", "01", "1"),
    ]
    got = {(r.month, r.estimate_type_code): (r.pm_flag, r.prior_flag)
           for r in D.sample_detail(weighted(spark, rows)).collect()}
    assert got[("01", "1")] == ("A", None)
    assert got[("12", "3")] == ("X", "U")


def test_incomplete_report_keys_have_no_counterpart(spark):
    rows = [report(month="06", reptw=None), report(month="07", reptw=None), report(month="07", reptw=None, rept="2")]
    got = D.sample_detail(weighted(spark, rows)).collect()
    assert len(got) == 3 and all(r.pm_flag is None for r in got)


def test_asked_periods_only(spark):
    rows = [report(month=m, closing=c) for m in ("05", "06", "07") for c in "12"]
    asked = spark.createDataFrame([("2021", "07", "2")], "year string, month string, estimate_type_code string")
    got = D.sample_detail(weighted(spark, rows), asked).collect()
    assert [(r.month, r.estimate_type_code, r.pm_flag, r.prior_flag) for r in got] == [("07", "2", "T", "T")]


def test_negative_employment_leaves_the_detail(spark):
    assert D.sample_detail(weighted(spark, [report(pm=-1)])).count() == 0


def test_rollup_unites_and_blanks(spark):
    rows = [
        report(rept="1", naics="561110", codes=("21", "11", "12", None)),
        report(rept="2", naics="561320", codes=("21", None, "11", "12"), weight=3.0, selsize=None),
        report(rept="3", naics="561999", flag="A", origflag="T"),
    ]
    got = {r.flag: r for r in D.ui_rollup(D.sample_detail(weighted(spark, rows))).collect()}
    both = got["T"]
    assert (both.detail_count, both.pm, both.cm, both.wpm) == (2, 20, 24, 50.0)
    assert (both.pmcc, both.cmcc, both.naics) == ("11,21", "11,12", "561")
    assert (both.weight, both.selsize, both.szgap) == (None, None, None)
    assert (both.report, both.row_type, both.is_summed) == ("W1", "summary", True)
    assert (got["A"].report, got["A"].row_type, got["A"].weight) == ("013", "single", 2.0)


def test_shortlist_equals_brute_force_with_a_hot_selection(spark):
    random.seed(3)
    columns = [*SELECTION, *UNIT_GROUP, "wotm", "report", "origflag"]
    rows = []
    for n in range(3000):
        series = "10000000" if n % 3 else f"2000{n % 7}"
        flag = random.choice([None, "A", "T", "T", "U", "X"])
        wotm = random.choice([None, *map(float, range(-20, 20))])
        rows.append(("01", "0", series, "01", "2021", "07", "2", random.choice(["01", "02"]), f"{n:05d}", flag,
                     n % 2 == 0, wotm, f"R{n}", random.choice([flag, flag, "T"])))
    rollup = spark.createDataFrame(rows, ", ".join(
        f"{c} {'boolean' if c == 'is_knr' else 'double' if c == 'wotm' else 'string'}" for c in columns))

    groups = {}
    for r in rows:
        groups.setdefault(r[:7], []).append(r)

    def first(v):  # nulls first
        return (v is not None, v if v is not None else 0)

    expected = set()
    for key, members in groups.items():
        members.sort(key=lambda r: (first(r[9]), first(None if r[11] is None else -abs(r[11])), r[7], r[8], r[12]))
        for place, r in enumerate(members):
            changed = r[9] is not None and r[13] is not None and r[9] != r[13]
            if place < 31 or r[9] == "X" or changed:
                expected.add((r[12], len(members)))
    got = {(r.report, r.total_rows) for r in D.review_shortlist(rollup).collect()}
    assert got == expected


def test_display_order(spark):
    rows = D.sample_detail(weighted(spark, [report(rept="1", flag="T", pm=10, cm=20), report(rept="2", flag="T", pm=10, cm=90),
                                            report(rept="3", flag="A", pm=5, cm=6), report(rept="4", flag="T", pm=90, cm=10)]))
    # Flags in order, then the largest change in either direction, then ids.
    assert [r.report for r in rows.orderBy(*D.display_order()).collect()] == ["013", "012", "014", "011"]


def test_group_detail_returns_the_rows_behind_a_group(spark):
    rows = D.sample_detail(weighted(spark, [report(rept="1"), report(rept="2"), report(rept="3", ui="U2")]))
    groups = D.ui_rollup(rows).filter("is_summed")
    assert sorted(r.report for r in D.group_detail(rows, groups).collect()) == ["011", "012"]


def test_detail_rollup_and_summary_agree(spark):
    rows = [report(rept=str(n), ui=f"U{n % 3}", flag="TA"[n % 2], pm=n, cm=2 * n, weight=1.0) for n in range(1, 40)]
    w = weighted(spark, rows)
    per_flag = {r.a_typ_flag: r for r in flag_summary(w).collect()}
    units = {r.flag: r for r in D.ui_rollup(D.sample_detail(w)).groupBy("flag").agg(
        F.sum("pm").alias("pm"), F.sum("cm").alias("cm"), F.sum("detail_count").alias("n")).collect()}
    for flag in "TA":
        assert per_flag[flag].pm_emp == units[flag].pm and per_flag[flag].cm_emp == units[flag].cm
        assert per_flag[flag].rep_count == units[flag].n


def published(spark):
    return spark.createDataFrame(
        [("01", "00000", "10000000", "01", "2021", "07", "2", 1000, 2000),
         ("01", "00000", "10000000", "85", "2021", "07", "2", 0, 5)],
        ", ".join(f"{c} string" for c in SELECTION) + ", pm_est bigint, pub_est bigint")


def test_summary_rows_and_order(spark):
    rows = [report(rept="1", flag="T"), report(rept="2", flag="A", pm=5, cm=5), report(rept="3", flag="X"),
            report(rept="4", month="06", flag="T", pm=100, cm=200, weight=1.0)]
    got = sample_summary(weighted(spark, rows), published(spark)).filter("data_type_code = '01'")
    table = {r["sample"]: r for r in got.orderBy("row_order").collect()}
    assert list(table) == ["T", "A", "Sum", "Coverage", "Pm-Covg", "Inc", "Const", "X"]
    assert (table["Sum"].pm, table["Sum"].wpm, table["Sum"].report) == (15.0, 25.0, 2)
    assert table["Coverage"].pm == 0.015 and table["Coverage"].cm == 17 / 2000
    assert table["Pm-Covg"].pm == 0.1 and table["Pm-Covg"].wcm == 0.1
    assert table["X"].otm == 0


def test_selection_without_sample_still_has_totals(spark):
    got = sample_summary(weighted(spark, [report()]), published(spark)).filter("data_type_code = '85'")
    rows = {r["sample"]: r for r in got.collect()}
    assert set(rows) == {"Sum", "Coverage", "Pm-Covg"}
    assert rows["Sum"].pm == 0.0 and rows["Coverage"].pm is None and rows["Coverage"].cm == 0.0


def what_if(spark, proposals):
    detail = D.sample_detail(weighted(spark, [report(rept="1", flag="T", pm=10, cm=20, weight=3.0),
                                              report(rept="2", flag="A", pm=5, cm=7)]))
    keys = ", ".join(f"{c} string" for c in (*SELECTION, *D.REPORT_KEY))
    base = ("01", "00000", "10000000", "01", "2021", "07", "2", "01", "U1", "W1")
    changes = spark.createDataFrame([(*base, r, f) for r, f in proposals], keys + ", new_flag string")
    inputs = spark.createDataFrame(
        [(*base[:7], 150.0, 100.0, 90.0, 2.0, 0.0, 5.0, 7.0, 30.0, 60.0)],
        ", ".join(f"{c} string" for c in SELECTION)
        + ", cm double, pm double, py double, bdf double, nse double, apm double, acm double, twpm double, twcm double")
    return whatif.what_if_reflag(detail, changes, inputs).first()


def test_what_if_without_changes_keeps_the_totals(spark):
    got = what_if(spark, [])
    assert (got.apm, got.acm, got.twpm, got.twcm, got.link) == (5.0, 7.0, 30.0, 60.0, 2.0)
    assert got.n_recalc_cm == round((100 - 5) * 2.0) + 7 + 2


def test_what_if_moves_a_report_between_totals(spark):
    got = what_if(spark, [("011", "A"), ("012", "X")])
    assert (got.apm, got.acm, got.twpm, got.twcm) == (10.0, 20.0, 0.0, 0.0)
    assert got.link == 1.0 and got.n_recalc_cm == 90 + 20 + 2
