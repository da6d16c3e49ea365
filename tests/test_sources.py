"""CSV rejects, order of files, vintages in one scan."""

import pytest
from pyspark.sql import functions as F

from checks.tables import DerivedTables
from estilens.operators import basic, periods
from estilens.sources import readers, schemas
from test_plans import SF_DIR, needs_data, plan

LINES = [
    "1000001,001,125,120,5", "1000001,002,7", "1000002,001,x,120,5", "1000002,002,1,2,3,4", "", "1000003,\"a,b\",1,2,3",
    "1000004,004,,,", "1000005,005,99999999999999999999,1,1",
]


def test_lines_are_rows_or_rejects(spark, tmp_path):
    (tmp_path / "r.csv").write_text("parent_report,report,cm,pm,otm\n" + "\n".join(LINES) + "\n")
    found = readers.ingest_csv(spark, str(tmp_path / "r.csv"), schemas.PLAIN_REPORTS, root=str(tmp_path))
    rows = sorted((r.parent_report, r.report, r.cm) for r in found.rows.collect())
    assert rows == [("1000001", "001", 125), ("1000003", "a,b", 1), ("1000004", "004", None)]
    rejects = found.rejects.collect()
    assert sorted(r.record for r in rejects) == sorted([LINES[1], LINES[2], LINES[3], LINES[7]])
    assert all(r.file.endswith("r.csv") for r in rejects)
    # An empty line is no record; all others are in one of the two parts, also where only they are counted.
    assert found.rows.count() + found.rejects.count() == len(LINES) - 1
    assert found.rows.select("cm").filter("cm > 0").count() == 2


@pytest.mark.parametrize("size,blocks", [("200", 6), ("1m", 3)])
def test_order_of_files_in_any_number_of_blocks(spark, tmp_path, size, blocks):
    expected = []
    for k in range(3):
        names = [f"o{(i * 7 + k * 5) % 90:02d}" for i in range(40 + k)]
        (tmp_path / f"part-{k}.csv").write_text("name,n\n" + "".join(f"{name},{i}\n" for i, name in enumerate(names)))
        expected += [name for name in names if name not in expected]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, size)
        rows = readers.with_file_place(spark.read.schema("name string, n int").csv(str(tmp_path), header=True))
        options = basic.options_first_seen(rows, "name", F.col("file_place"))
        got = [r.option for r in options.orderBy("first_seen").collect()]
        read = rows.select("file_place.file", "file_place.block").distinct().count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == expected and read == blocks


@needs_data
def test_vintages_are_one_scan_pruned_while_it_runs(spark, tmp_path):
    t = DerivedTables(spark, SF_DIR)
    rows = t.restated_estimates
    path = str(tmp_path / "estimates")
    # Archives written before a column was added.
    rows.filter("vintage <> 'current'").drop("birth_death_factor").write.partitionBy("vintage").parquet(path)
    rows.filter("vintage = 'current'").write.partitionBy("vintage").mode("append").parquet(path)
    facts = readers.read_vintage_partitions(spark, path, rows.schema)
    held = periods.held_periods(rows)
    held.write.parquet(str(tmp_path / "held"))
    held = spark.read.schema(held.schema).parquet(str(tmp_path / "held"))
    asked = t.release_vintages.filter("year = '1999' AND month = '11'")
    read = periods.as_read(facts, asked, held)
    text = plan(read)
    assert "dynamicpruning" in text.lower()
    assert text.count(f"InMemoryFileIndex(1 paths)[file:{path}]") <= 1
    columns = [c for c in rows.columns if c not in ("vintage", "birth_death_factor")]
    expected = periods.as_read(rows, asked)
    assert sorted(map(str, read.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))
    assert read.filter("birth_death_factor IS NOT NULL").count() == 0  # 1999 and 1998 are archives
    newest = periods.as_read(facts, t.release_vintages.filter("view = 'current'"), held)
    assert newest.filter("birth_death_factor IS NULL").count() == 0 < newest.count()
