import pytest
from pyspark.sql import functions as F

from estilens.functions import codes as C
from estilens.functions import comments
from estilens.functions import months as M
from estilens.functions import numbers as N
from estilens.functions.sizes import size_bracket, size_gap


@pytest.mark.parametrize("value, expected", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-0.5, 0.0), (-1.5, -2.0), (None, None)])
def test_round_half_even(evaluate, value, expected):
    got = evaluate(lambda x: N.round_half_even(x.cast("double")), value)
    assert got == expected and str(got) != "-0.0"


def test_rounded_total_is_exact_in_any_order(spark):
    values = [0.1] * 15 + [1e9 + 0.25, -1e9, 0.75]  # 2.5 in all
    for order in (values, values[::-1]):
        rows = spark.createDataFrame([(v,) for v in order], "x double").repartition(4)
        row = rows.agg(N.whole_sum(F.col("x")).alias("w"), N.fraction_sum(F.col("x")).alias("f"))
        assert row.select(N.rounded_total(F.col("w"), F.col("f")).alias("t")).first()["t"] == 2.0


def test_distinct_count_counts_null_once(spark):
    rows = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "x string")
    assert rows.agg(N.distinct_count(F.col("x")).alias("n")).first()["n"] == 3
    assert rows.filter("x is null").agg(N.distinct_count(F.col("x")).alias("n")).first()["n"] == 1


@pytest.mark.parametrize("values, expected", [
    (["a", "a"], "a"), (["a", "b"], ""), (["a", None], ""), ([None, None], None)])
def test_agreed_value(spark, values, expected):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    assert rows.agg(N.agreed_value(F.col("x"), F.lit("")).alias("v")).first()["v"] == expected


@pytest.mark.parametrize("left, right, expected", [
    ("123456", "123999", "123"), ("12", "123", "12"), ("9", "1", ""), (None, "1", ""), ("", "", "")])
def test_common_prefix(evaluate, left, right, expected):
    assert evaluate(lambda a, b: C.common_prefix(a.cast("string"), b.cast("string")), left, right) == expected


@pytest.mark.parametrize("account, expected", [
    ("jane.doe@x.org", "Jane"), ("ces_sa", "*Auto"), ("mary-ann", "Mary-Ann"), (None, None)])
def test_verifier_name(evaluate, account, expected):
    assert evaluate(lambda a: C.verifier_name(a.cast("string")), account) == expected


def test_flag_counts(evaluate):
    def got(text):
        return [tuple(p) for p in evaluate(C.flag_counts, text)]
    assert got("A: 3, T :5") == [("A", "3"), ("T", "5")]
    assert got("A: 3 and more") == [] and got("") == []


def test_code_order_puts_text_after_numbers(spark):
    rows = spark.createDataFrame([("9",), ("10",), ("x",), ("07",)], "c string")
    got = [r.c for r in rows.orderBy(C.code_order(F.col("c"))).collect()]
    assert got == ["07", "9", "10", "x"]


LABELS = [
    ("OT, Amt: 912, Type: OTMC  {MS}  removing", "MS-m: 912"),
    ("RW, Amt: 352, adj Y1 weight to unweighted sample coverage of 0.126337 {SR} , This NAICS", "RW-u: 352"),
    ("Manual, Amt: -4 weights {SM}", "RW-m: -4"),
    ("EM, Amt: 7 by hand {MR}", "EM: 7"),
    ("RW, Amt: 352 no subtype {SR}", "12"),
    ("nothing to read", "12"),
    (None, "12"),
]


@pytest.mark.parametrize("comment, expected", LABELS)
def test_adjustment_label(evaluate, comment, expected):
    def build(text, adjusted):
        p = comments.adjustment_parts(text.cast("string"))
        return comments.adjustment_label(p["adjtype"], p["adjamt"], p["adjsubtype"], p["adjreason"], adjusted)
    assert evaluate(build, comment, 12.9) == expected


def test_size_brackets_and_gap(evaluate):
    assert [evaluate(size_bracket, v) for v in (0, 9, 10, 999, 1000)] == [1, 1, 2, 7, 8]
    assert evaluate(lambda v: size_bracket(v), -1) is None
    assert evaluate(lambda v: size_bracket(v), 9.5) is None
    assert evaluate(lambda a, b, s: size_gap(a, b, s), 3, 5, "2") == 3
    assert evaluate(lambda a, b, s: size_gap(a, b, s), 1, 1, "4") == 0
    assert evaluate(lambda a, b, s: size_gap(a, b, s.cast("string")), 1, 1, None) is None


def expected_period(year, month, closing):
    """The release rules, written out by hand."""
    if month == 1:
        prior = (year - 1, 12, "3")
    elif closing == "3":
        prior = (year, month - 1, "3" if month == 12 else "4")
    else:
        prior = (year, month - 1, "2")
    ago = "4" if closing == "3" or month < 10 else "3"
    benchmark = year if closing == "3" else year - 1
    earlier = {"1": None, "2": "1", "3": "1" if month == 12 else "2"}[closing]
    return prior, ago, benchmark, earlier


def test_release_rules_for_every_month_and_closing(spark):
    asked = [("2021", f"{m:02d}", c) for m in range(1, 13) for c in "123"]
    rows = spark.createDataFrame(asked, "year string, month string, closing string")
    y, m, c = F.col("year"), F.col("month"), F.col("closing")
    py, pm, pc = M.prior_month_release(y, m, c)
    for r in rows.select("*", py.alias("py"), pm.alias("pm"), pc.alias("pc"),
                         M.year_ago_release(y, m, c)[2].alias("ago"), M.benchmark_year(y, c).alias("b"),
                         M.earlier_closing(m, c).alias("e")).collect():
        prior, ago, benchmark, earlier = expected_period(2021, int(r.month), r.closing)
        assert (int(r.py), int(r.pm), r.pc) == prior
        assert (r.ago, int(r.b), r.e) == (ago, benchmark, earlier)
