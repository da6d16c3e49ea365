"""Interval joins against comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from estilens.functions.sizes import SIZE_BRACKETS, size_bracket, size_gap
from estilens.operators.intervals import cell_edges, in_intervals, sizes_by_table


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    values = [(k, rng.choice([rng.randrange(-50, 300), rng.random() * 200, None, 100.0, 1e12])) for k in range(400)]
    brackets = [(n, float(lo), float(lo + rng.choice([0, 3, 40, 500]))) for n, lo in enumerate(rng.sample(range(-20, 220), 40))]
    brackets += [(90, None, 5.0), (91, 250.0, None), (92, None, None), (93, 10.0, 5.0), (94, 100.0, 100.0)]  # open, wrong way round, one value
    return (spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values], "id int, v double").repartition(3), values,
            spark.createDataFrame(brackets, "size int, low double, high double"), brackets)


def plain(values, brackets, left):
    out = []
    for k, v in values:
        found = [n for n, lo, hi in brackets if v is not None and (lo is None or v >= lo) and (hi is None or v <= hi) and (lo is None or hi is None or lo <= hi)]
        out += [(k, n) for n in found] or ([(k, None)] if left else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("cells", [1, 7, 512])
def test_equals_all_pairs(tables, how, cells):
    rows, values, table, brackets = tables
    found = in_intervals(rows, "v", table, "low", "high", how, cells)
    assert found.columns == ["id", "v", "size", "low", "high"]
    assert sorted(((r.id, r["size"]) for r in found.collect()), key=str) == plain(values, brackets, how == "left")


def test_rows_and_intervals_meet_by_equality(tables):
    rows, _, table, _ = tables
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = in_intervals(rows, "v", table, "low", "high")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_number_of_edges_is_bounded(tables):
    _, _, table, _ = tables
    many = table.sparkSession.range(20_000).select(F.col("id").cast("double").alias("low"), (F.col("id") + 2).cast("double").alias("high"))
    assert len(cell_edges(many, "low", "high", 32)) <= 33
    got = in_intervals(table.sparkSession.range(0, 20_000, 500).withColumn("v", F.col("id").cast("double")), "v", many, "low", "high", cells=32)
    assert got.groupBy("id").count().agg(F.min("count"), F.max("count")).first()[:] == (1, 3)


def test_no_intervals_and_no_rows(tables):
    rows, values, table, _ = tables
    assert in_intervals(rows, "v", table.limit(0), "low", "high").count() == 0
    assert in_intervals(rows, "v", table.limit(0), "low", "high", "left").count() == len(values)
    assert in_intervals(rows.limit(0), "v", table, "low", "high").count() == 0


def test_the_fixed_brackets_as_a_table(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame(
        [(k, rng.choice([0, 9, 10, 99, 100, 1000, 5000, None]), rng.randrange(2000), str(k % 9)) for k in range(200)], "id int, pm bigint, cm bigint, selsize string")
    table = spark.createDataFrame(SIZE_BRACKETS, "size int, low bigint, high bigint")
    pm, cm = size_bracket(F.col("pm")), size_bracket(F.col("cm"))
    expected = rows.select("id", pm.alias("pm_size"), cm.alias("cm_size"), size_gap(pm, cm, F.col("selsize")).alias("szgap"))
    got = sizes_by_table(rows, table).select(*expected.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
