"""Shapes of the physical plans that matter at full size."""

import os
import re

import pytest
from pyspark.sql import functions as F

from checks.tables import DerivedTables
from estilens.keys import PERIOD
from estilens.operators import detail, estimates, sample
from estilens.operators import periods
from estilens.plans.review import ReviewTables, of_series, read_review, review, write_review
from estilens.plans.stages import run_root, stage_root, staged
from estilens.sources import readers, schemas

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")

def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    tables = DerivedTables(spark, SF_DIR)
    for name in ("sample", "estimates"):
        getattr(tables, name).write.partitionBy("year").parquet(f"{root}/{name}")
    return {n: spark.read.schema(getattr(tables, n).schema).parquet(f"{root}/{n}") for n in ("sample", "estimates")}


@needs_data
def test_detail_moves_the_sample_once(stored):
    text = plan(detail.sample_detail(sample.weighted_sample(stored["sample"])))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@needs_data
def test_summaries_move_the_sample_once_and_multiply_no_row(stored):
    for build in (sample.flag_summary, sample.sign_summary):
        text = plan(build(sample.weighted_sample(stored["sample"])))
        assert "Expand" not in text
        moves = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "report_id" in line]
        assert len(moves) == 1 and text.count("FileScan") == 1


@needs_data
def test_history_uses_one_exchange(stored):
    text = plan(estimates.series_history(stored["estimates"]))
    assert text.count("Exchange hashpartitioning") == 1


@needs_data
def test_comparison_adds_no_exchange(spark):
    t = DerivedTables(spark, SF_DIR)
    count = lambda rows: plan(rows).count("Exchange")
    assert count(estimates.estimate_comparison(t.info)) == count(t.info)


@needs_data
def test_filters_and_columns_reach_the_scan(stored):
    w = sample.weighted_sample(stored["sample"]).filter((F.col("state_fips_code") == "01") & (F.col("year") == "2000"))
    text = plan(sample.flag_summary(w))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(state_fips_code,01\)", text)
    assert "naics_code" not in text.split("ReadSchema")[1]


@needs_data
def test_release_months_prune_partitions(stored):
    near = periods.near_months(stored["sample"], [("2000", "01", "2")])
    text = plan(near)
    assert re.search(r"PartitionFilters: \[[^]]*(1999|2000)", text)
    got = {(r.year, r.month) for r in near.select("year", "month").distinct().collect()}
    assert got == {("2000", "01"), ("1999", "12")}
    wider = periods.near_months(stored["sample"], [("2000", "01", "2")], year_ago=True)
    assert {("1999", "01")} <= {(r.year, r.month) for r in wider.select("year", "month").distinct().collect()}


@needs_data
def test_review_of_one_series_equals_the_review_of_all(spark, tmp_path):
    t = DerivedTables(spark, SF_DIR)
    tables = ReviewTables(t.estimates, t.sample, t.structure, t.small_domain, t.third_gen)
    asked = [("2000", "06", "2")]
    everything = review(tables, asked, k=2, stage=True)
    write_review(everything, str(tmp_path / "out"), asked)
    key = everything["sample_detail_by_ui"].select("state_fips_code", "area_fips_code", "series_code").first()
    single = review(of_series(tables, *key), asked, k=2)
    for name in ("sample_summary", "sample_detail_by_ui", "estimate_comparison", "series_history"):
        whole = everything[name].filter(
            (F.col("state_fips_code") == key[0]) & (F.col("area_fips_code") == key[1]) & (F.col("series_code") == key[2]))
        rows = sorted(map(str, single[name].collect()))
        assert rows and rows == sorted(map(str, whole.select(*single[name].columns).collect())), name
    assert {p.name for p in (tmp_path / "out").iterdir()} == {*everything, "_manifest"}
    for name in ("sample_summary", "series_history"):
        again = read_review(spark, str(tmp_path / "out"), name)
        assert again.schema == everything[name].schema and sorted(map(str, again.collect())) == sorted(map(str, everything[name].collect())), name


def test_stages_are_written_under_the_stage_root(spark):
    root = stage_root(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert root == stage_root(spark) and (not named or root == named)
    assert run_root(spark).startswith(root) and run_root(spark) != run_root(spark)
    rows = staged(spark.range(5), "five")
    assert rows.count() == 5
    assert all(root.removeprefix("file:").rstrip("/") in f for f in rows.inputFiles())


def test_csv_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "r.csv").write_text("parent_report,report,cm,pm,otm\n1000001,001,125,120,5\n")
    row = readers.read_csv(spark, str(tmp_path / "r.csv"), schemas.PLAIN_REPORTS).first()
    assert (row.report, row.cm) == ("001", 125)


def test_lookup_has_one_row_per_key(spark, tmp_path):
    (tmp_path / "r.csv").write_text("series_code,series_name\n01,a\n01,b\n02,c\n")
    rows = readers.read_lookup(spark, str(tmp_path / "r.csv"), schemas.SERIES_TITLES, "series_code", "series_name")
    assert sorted(map(tuple, rows.collect())) == [("01", "b"), ("02", "c")]


def test_vintage_files(spark, tmp_path):
    for name in ("estimates_archive_2019", "estimates_archive_2020", "estimates_current", "third_archive", "third_current"):
        spark.createDataFrame([(name,)], "file string").write.parquet(str(tmp_path / name))
    rows = readers.read_vintages(spark, str(tmp_path), "estimates", ["2019", "2020", "current"]).collect()
    assert {(r.file, r.vintage) for r in rows} == {
        ("estimates_archive_2019", "2019"), ("estimates_archive_2020", "2020"), ("estimates_current", "current")}
    rows = readers.read_models(spark, str(tmp_path), "third").collect()
    assert {(r.file, r.vintage) for r in rows} == {("third_archive", "archive"), ("third_current", "current")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_vintages(spark, str(tmp_path), "estimates", ["2018"]).count()


@needs_data
def test_review_of_two_vintages_equals_two_reviews_of_one(spark):
    """Releases of two benchmark years whose rows stand in both, with other values."""
    t = DerivedTables(spark, SF_DIR)
    asked = [("2000", "06", "2"), ("2001", "06", "2")]

    def two(rows, *values):
        one = rows.filter(F.col("year").isin("1999", "2000", "2001")).drop("bmrk_year")
        other = one.withColumns({v: F.col(v) * 2 + 1000 for v in values})
        return one.withColumn("vintage", F.lit("1999")).unionByName(other.withColumn("vintage", F.lit("2000")))

    estimates_of = two(t.estimates, "published_estimate_value", "upper_tolerance")
    sample_of = two(t.sample, "cm_value")
    tables = ReviewTables(estimates_of, sample_of, t.structure)
    whole = review(tables, asked, stage=True)
    for (year, *rest), v in zip(asked, ("1999", "2000")):
        single = ReviewTables(*(x.filter(F.col("vintage") == v).drop("vintage") for x in (estimates_of, sample_of)), t.structure)
        part = review(single, [(year, *rest)], stage=True)
        for name in ("estimate_comparison", "sample_summary", "sample_detail", "series_history", "sample_history"):
            key = next(c for c in ("sel_year", "cur_year", "year") if c in part[name].columns)
            rows = sorted(map(str, part[name].collect()))
            assert rows and rows == sorted(map(str, whole[name].filter(F.col(key) == year).select(*part[name].columns).collect())), name


def test_a_vintage_that_is_not_stored_is_an_error(spark):
    table = spark.createDataFrame([("2020", "11", "3", v) for v in ("2020", "current")], "year string, month string, estimate_type_code string, vintage string")
    needed = periods.vintages_needed(table.select("year", "month", "estimate_type_code").distinct(), table.select("vintage"))
    with pytest.raises(ValueError, match="2019"):
        periods.require_held(needed)
