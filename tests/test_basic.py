from pyspark.sql import functions as F

from estilens.operators import basic

REPORTS = "sample_group string, parent_report string, report string, cm bigint, pm bigint, otm bigint"


def test_parent_rollup_and_detail(spark):
    rows = spark.createDataFrame(
        [("m", "P1", "R2", 44, 45, -1), ("m", "P1", "R1", 125, 120, 5), ("r", "P2", "R1", 10, 10, 0)], REPORTS)
    got = {r.parent_report: r for r in basic.parent_rollup(rows).collect()}
    assert (got["P1"].report_count, got["P1"].pm, got["P1"].cm, got["P1"].otm, got["P1"].expandable) == (2, 165, 169, 4, True)
    assert not got["P2"].expandable
    parents = spark.createDataFrame([("P1",)], "parent_report string")
    assert sorted(r.id for r in basic.parent_detail(rows, parents).collect()) == ["P1-R1", "P1-R2"]


def test_two_lines_are_labelled(spark):
    rows = spark.createDataFrame([("s", 2025, 7, 1180, 1175), ("t", 2025, 8, 1, 2)],
                                 "data_series string, year bigint, month bigint, estimate bigint, benchmark bigint")
    assert [r.label for r in basic.two_line_series(rows, "s").collect()] == ["Jul 2025"]


def test_options_keep_first_seen_order_and_repair_requests(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "n int, v string")
    options = basic.options_first_seen(rows, "v", F.col("n"))
    assert [r.option for r in options.orderBy("first_seen").collect()] == ["b", "a"]
    assert basic.requested_or_first(options, "a").first().option == "a"
    assert basic.requested_or_first(options, "zz").first().option == "b"
