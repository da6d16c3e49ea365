"""What history steps move, and that tables read several times are read from where they were written."""

import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from checks.tables import DerivedTables
from estilens.keys import PART, SERIES, VIEW
from estilens.operators import detail, history
from estilens.operators.sample import flag_summary

STORED = f"""{', '.join(f'{c} string' for c in SERIES)}, year string, month string, version string, reptstate string, ui string, reptw string,
  report string, naics string, selsize bigint, weight double, origdwght double, dwght double, drr double, pm bigint, cm bigint, origflag string,
  flag string, otm bigint, wotm double, wpm double, wcm double, is_knr boolean, cmcc string, views array<string>, valid_from bigint"""
REPORTS = f"view string, {', '.join(f'{c} string' for c in SERIES)}, year string, month string, estimate_type_code string, report string, is_knr boolean, flag string"
KEYS = ("01", "00000", "10000000", "01")


def stored(year, month, report, views=("2000",)):
    valid = (int(year) * 12 + int(month) - 1) * 10 + 1
    return (*KEYS, year, month, "1", "01", "1", "1", report, "20", 1, 1.0, 1.0, 1.0, 1.0, 5, 7, "A", "A", 2, 2.0, 5.0, 7.0, False, "", list(views), valid)


def asked(year, month, report, flag="A", view="2000"):
    return (view, *KEYS, year, month, "1", report, False, flag)


@pytest.fixture
def past(spark):
    store = spark.createDataFrame([stored("2000", "01", "r1"), stored("2000", "06", "r1"), stored("2000", "06", None), stored("2000", "07", "r1", ["1999"])], STORED)
    reports = spark.createDataFrame([asked("2000", "06", "r1"), asked("2000", "06", "r1"), asked("2000", "06", None)], REPORTS)
    return history.unfold_history(store, reports, keep_view=True, parts=3)


def test_steps_by_report_move_no_unfolded_row(spark, past):
    segments = history.month_segments(history.history_rollup(past, "detail"), "detail")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = segments._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan.split("Join")[0]


def test_repeated_reports_and_gaps(past):
    rollup = history.history_rollup(past, "detail")
    assert sorted((r.month, float(r.pm), r.report_rows) for r in rollup.collect()) == [("01", 10.0, 2), ("06", 10.0, 2)]
    segments = history.month_segments(rollup, "detail").drop(VIEW).collect()
    assert sorted((r.axis_year, r.axis_month, r.segment_end or "") for r in segments) == [
        ("1999", "12", "pm"), ("2000", "01", "cm"), ("2000", "02", ""), ("2000", "03", ""), ("2000", "04", ""), ("2000", "05", "pm"), ("2000", "06", "cm")]


@pytest.mark.parametrize("name", ["restated_sample_history", "restated_detail", "restated_sample_history_stored", "sample_history", "what_if_units", "shortlist_order"])
def test_the_given_lines_are_added_up_once(spark, name):
    """Queries read the written sample; none reads the lines again."""
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    files = QUERIES[name](tables).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_next_of_a_month_with_two_marks(spark):
    """Rows of one month under both knr marks: only the last one brings the empty months."""
    columns = f"{', '.join(f'{c} string' for c in SERIES)}, cur_year string, cur_month string, cur_closing string, reptstate string, ui string, report string, is_knr boolean, year string, month string, pm double, cm double, colour string"
    at = (*KEYS, "2000", "06", "1", "01", "1", "r1")
    rows = [(*at, k, "2000", m, 5.0, 7.0, "red") for k, m in ((False, "01"), (True, "01"), (False, "05"))]
    out = history.month_segments(spark.createDataFrame(rows, columns), "detail").filter(F.col("segment").isNull())
    assert sorted((r.axis_year, r.axis_month) for r in out.collect()) == [("2000", "02"), ("2000", "03")]


@pytest.fixture
def many(spark):
    """Stored rows and reports of 40 series with 25 reports each, in two months."""
    series = [("01", "00000", f"{n:08d}", "01") for n in range(40)]
    store = [(*key, *stored("2000", month, f"r{r}")[4:]) for key in series for r in range(25) for month in ("01", "06")]
    reports = [("2000", *key, "2000", "06", "1", f"r{r}", False, "A") for key in series for r in range(25)]
    return spark.createDataFrame(store, STORED), spark.createDataFrame(reports, REPORTS)


def test_units_add_up_in_their_part(many):
    """Reports of a series are in few parts of even size, so few rows per unit move; results don't depend on it."""
    store, reports = many
    dealt = history.unfold_history(store, reports, keep_view=True, parts=8, slots=history.history_slots(reports, 8))
    held = dealt.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series_code").alias("series")).collect()
    assert len(held) > 4 and max(r.n for r in held) <= 2 * 2000 / 8
    assert sum(r.series for r in held) <= 3 * 40
    plain = history.unfold_history(store, reports, keep_view=True, parts=8)
    assert plain.columns[:7] == [VIEW, *SERIES, "report", "year"] and plain.columns == [c for c in dealt.columns if c != PART]
    for row_type in ("summary", "detail"):
        was = history.history_rollup(plain, row_type)
        now = history.history_rollup(dealt, row_type).drop(PART)
        assert was.columns == now.columns and sorted(map(str, was.collect())) == sorted(map(str, now.collect()))
        was, now = (history.month_segments(x, row_type) for x in (was, history.history_rollup(dealt, row_type)))
        assert sorted(map(str, was.collect())) == sorted(map(str, now.drop(PART).collect()))


def test_dealt_steps_move_rows_once(spark, many):
    """By report nothing moves after the join; by unit what a part added up does, once."""
    store, reports = many
    slots = spark.createDataFrame(history.history_slots(reports, 8).collect())
    dealt = history.unfold_history(store, reports, keep_view=True, parts=8, slots=slots)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for row_type, moves in (("detail", 0), ("summary", 1)):
            out = history.month_segments(history.history_rollup(dealt, row_type), row_type)
            plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            assert plan.split("SortMergeJoin")[0].count("Exchange") == moves
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _physical(rows):
    return rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_lines_add_up_by_hash(spark):
    assert "SortAggregate" not in _physical(DerivedTables(spark, "/root/testdata/sf0.001")._reports())


@pytest.mark.parametrize("highest, lowest", [("R", "A"), ("S", "B"), ("A", "A"), ("N", "A"), ("Z", "R"), ("R", "R"), ("r", "Aa"), ("A", None)])
def test_flags_follow_the_order_of_texts(spark, tmp_path, highest, lowest):
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    rows = spark.createDataFrame([(1, 1, 1, 1, 1.0, 4000.0, 0.1, 0.1, f, "F", None) for f in (highest, lowest, None)], line)
    rows.withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    shown = DerivedTables(spark, str(tmp_path))._reports().select("a_typ_flag", "original_a_typ_flag").collect()
    assert [tuple(r) for r in shown] == [tuple({"R": "T", "A": "A"}.get(f, "U") for f in (highest, lowest or highest))]


def test_sorts_begin_with_a_hash(spark):
    """Keys of a selection begin alike, so a sort by them compares whole keys nearly every time."""
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        for rows in (detail.sample_detail(tables.weighted), detail.ui_rollup(tables.stored_detail), flag_summary(tables.weighted)):
            assert "xxhash64(state_fips_code" in _physical(rows)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_stored_tables_hold_what_is_read_from_them(spark):
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    assert not any(c.endswith("_url") for c in [*tables.stored_detail.columns, *tables.stored_units.columns])
    assert "pmcc" in tables.stored_detail.columns and "pmcc" not in tables.stored_units.columns


def test_detail_moves_only_what_does_not_follow_from_a_row(spark):
    """Rows move once, in the parts asked for; sums, sizes, distances and the hash of the sort are added after that."""
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    stored = tables.sample  # written before the setting is changed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        rows = detail.sample_detail(tables.weighted, parts=5)
        assert rows.rdd.getNumPartitions() == 5 and stored.inputFiles()
        after, before = _physical(rows).split("Exchange", 1)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in before and "xxhash64(state_fips_code" in after
    for name in ("otm", "wpm", "wcm", "code", "pm_distance", "prior_distance", "pm_size", "cm_size"):
        assert f" AS {name}#" in after and f" AS {name}#" not in before.replace(" AS wpm#", "", 1).replace(" AS wcm#", "", 1), name


def test_parts_of_detail_follow_the_reports(spark):
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    whole = sorted(map(str, detail.sample_detail(tables.weighted).collect()))
    assert whole == sorted(map(str, detail.sample_detail(tables.weighted, parts=3).collect()))
    assert f", {tables.parts(tables.sample, 100_000)}), REPARTITION_BY_NUM" in _physical(tables.viewed_detail)
    assert tables.parts(tables.sample, 100) == tables.sample.count() // 100 + 8


def test_calendars_come_from_the_months_of_the_sample(spark):
    """Periods, vintages and newest closings are found on the months, not on the reports."""
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    for rows in (tables.periods, tables.vintaged_months, tables.restated_months):
        assert all("/months-" in f for f in rows.inputFiles())
    of_reports = tables.restated_sample.select(*tables.restated_months.columns).distinct()
    assert sorted(map(str, of_reports.collect())) == sorted(map(str, tables.restated_months.collect()))
    assert sorted(map(tuple, tables.periods.collect())) == sorted(
        map(tuple, tables.estimates.select("year", "month", "estimate_type_code").filter("estimate_type_code <> '4'").distinct().collect()))


def test_the_join_of_histories_compares_numbers(spark, past):
    """Every two rows of a report are compared, so nothing is parsed there."""
    condition = _physical(past).split("Join", 1)[1].split("\n")[0]
    assert "valid_from" in condition and "cast(" not in condition


def test_histories_by_report_need_no_slots(spark):
    tables = DerivedTables(spark, "/root/testdata/sf0.001")
    plain, dealt = tables.past, tables.viewed_past.drop(VIEW, PART)
    assert not any("/slots-" in f for f in plain.inputFiles())
    assert plain.columns == dealt.columns and sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
