"""The sink of a review: reruns, runs that die, tables without rows."""

import re

import pytest
from pyspark.sql import functions as F

from estilens.plans.review import read_review, write_review

A, B, NONE = ("2000", "06", "2"), ("2000", "07", "1"), ("2001", "01", "3")
SELECTED = "state_fips_code string, area_fips_code string, series_code string, data_type_code string, year string, month string, estimate_type_code string, n int"
HISTORY = "series_code string, cur_year string, cur_month string, cur_closing string, year string, month string, n int"


def results(spark, releases, n, history=True):
    one = spark.createDataFrame([("01", "0", "s", "01", *r, n) for r in releases], SELECTED)
    two = spark.createDataFrame([("s", *r, "1999", m, n) for r in releases for m in ("01", "02") if history], HISTORY)
    return {"one": one, "two": two}


def held(spark, root, name):
    rows = read_review(spark, root, name)
    key = ("cur_year", "cur_month") if name == "two" else ("year", "month")
    return sorted((r[0], r[1], r[2]) for r in rows.groupBy(*key).agg(F.max("n")).collect())


def test_a_rerun_replaces_its_release_only(spark, tmp_path):
    root = str(tmp_path / "out")
    write_review(results(spark, [A, B], 1), root, [A, B])
    write_review(results(spark, [B], 2), root, [B])
    for name in ("one", "two"):
        assert held(spark, root, name) == [("2000", "06", 1), ("2000", "07", 2)]
    # A release that has lost its rows in one table.
    write_review(results(spark, [A], 3, history=False), root, [A])
    assert held(spark, root, "one") == [("2000", "06", 3), ("2000", "07", 2)]
    assert held(spark, root, "two") == [("2000", "07", 2)]
    assert read_review(spark, root, "two").schema.simpleString() == results(spark, [A], 1)["two"].schema.simpleString()


def test_a_run_that_dies_between_two_tables_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    write_review(results(spark, [A, B], 1), root, [A, B])
    dying = results(spark, [A, B], 2)
    dying["two"] = dying["two"].withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        write_review(dying, root, [A, B])
    for name in ("one", "two"):
        assert held(spark, root, name) == [("2000", "06", 1), ("2000", "07", 1)]
    write_review(results(spark, [A, B], 2), root, [A, B])
    for name in ("one", "two"):
        assert held(spark, root, name) == [("2000", "06", 2), ("2000", "07", 2)]


def test_other_releases_are_not_read(spark, tmp_path):
    root = str(tmp_path / "out")
    write_review(results(spark, [A, B], 1), root, [A, B])
    write_review(results(spark, [B], 2), root, [B])
    files = read_review(spark, root, "one")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^]]*release", files)) == 2
    with pytest.raises(ValueError, match="no complete run"):
        read_review(spark, root, "three")


def test_releases_without_any_row(spark, tmp_path):
    root = str(tmp_path / "out")
    write_review(results(spark, [], 1), root, [NONE])
    assert read_review(spark, root, "one").count() == 0 == read_review(spark, root, "two").count()
