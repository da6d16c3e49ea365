"""Distributed places against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from estilens.operators.ranks import with_rank


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef") if k % 3 else "hot", rng.randrange(40) if k % 7 else None, k) for k in range(900)]
    rows += [("ties", 5, k) for k in range(1000, 1300)] + [(None, 1, 2000), (None, None, 2001)]
    return spark.createDataFrame(rows, "g string, v int, id int").repartition(5), rows


def placed(rows, key):
    out, seen = {}, {}
    for r in sorted(rows, key=key):
        seen[r[0]] = seen.get(r[0], 0) + 1
        out[r[2]] = seen[r[0]]
    return out


@pytest.mark.parametrize("n", [1, 4, 37])
def test_places_within_groups(table, n):
    frame, rows = table
    got = {r.id: r.row_index for r in with_rank(frame, [F.desc_nulls_last("v"), F.col("id")], ["g"], partitions=n).collect()}
    assert got == placed(rows, lambda r: (r[1] is None, -(r[1] or 0), r[2]))


def test_places_in_the_whole_table(table):
    frame, rows = table
    got = sorted((r.place, r.v if r.v is not None else 99) for r in with_rank(frame, [F.asc_nulls_last("v")], name="place", partitions=16).collect())
    assert [p for p, _ in got] == list(range(1, len(rows) + 1))
    assert [v for _, v in got] == sorted(99 if r[1] is None else r[1] for r in rows)


def test_a_hot_group_and_a_hot_tie_are_spread(table):
    frame, _ = table
    ranked = with_rank(frame, [F.col("v")], ["g"], partitions=16)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    ranges = ranked.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in ranked.inputFiles()})
    held = {g: n for g, n in ranges.filter("g in ('hot', 'ties')").groupBy("g").agg(F.countDistinct("__range")).collect()}
    assert held["hot"] > 2 and held["ties"] > 2


def test_empty_table(table):
    assert with_rank(table[0].limit(0), [F.col("v")], ["g"]).count() == 0
