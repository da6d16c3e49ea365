"""Fixity audit against a plain comparison of records."""

import random

from pyspark.sql import functions as F

from estilens.llm import fixity
from texts import prose

PAGES = "page_id bigint, url string, html string, file string, hash string"


def pages_of(spark, n):
    rng = random.Random(9)
    rows = [(k, f"http://h{k % 3}.example/{k}", prose(rng, rng.randrange(200)), "?", "?") for k in range(n)]
    rows += [(5, "http://same.example", "x", "?", "?")] * 2 + [(None, None, None, "?", "?"), (7, None, "", "?", "?"), (8, "", prose(rng, 20_000), "?", "?")]
    return spark.createDataFrame(rows, PAGES)


def test_records_lie_end_to_end(spark):
    records = fixity.archive(pages_of(spark, 150), file_pages=50)
    places = {(r["file"], r["record"]): r["begin"] for r in fixity.index(records).collect()}
    files = {}
    for r in records.collect():
        files.setdefault(r["file"], []).append((places[r["file"], r["record"]], bytes(r["bytes"])))
    assert len(files) == 4
    for rows in files.values():
        at = 0
        for begin in sorted({b for b, _ in rows}):
            assert begin == at
            at += sum(len(x) for b, x in rows if b == begin)
    head, body = next(x for _, x in files["part-0.warc"]).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: resource\r\n") and int(head.rsplit(b" ", 1)[1]) == len(body) - 4


def test_audit_finds_exactly_the_damage(spark):
    records = fixity.archive(pages_of(spark, 150), file_pages=50)
    places = fixity.index(records)
    n = F.coalesce("page_id", F.lit(0))
    other = records.filter((n < 100) & (n % 40 != 3)).withColumn("bytes", F.when(n % 30 == 8, F.concat("bytes", F.lit(b"!"))).otherwise(F.col("bytes")))
    added = records.limit(1).withColumn("record", F.lit("new")).withColumn("file", F.lit("part-0.warc"))
    other = other.union(added)

    def leaves(rows):
        return {(r["file"], r["begin"]): (r["size"], r["hash"]) for r in fixity.leaves(rows, places).collect()}

    a, b = leaves(records), leaves(other)
    expected = {k: (a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    for range_bytes, fan in ((1 << 16, 16), (700, 3)):
        rows = fixity.audit(records, other, places, range_bytes, fan).collect()
        found = {(r["file"], r["begin"]): ((r["size_a"], r["hash_a"]) if r["hash_a"] else None, (r["size_b"], r["hash_b"]) if r["hash_b"] else None) for r in rows}
        assert len(rows) == len(found) and found == expected
        assert {r["kind"] for r in rows} == {"changed", "missing_a", "missing_b"}
    assert fixity.audit(records, records, places).count() == 0


def test_only_ranges_that_differ_differ_in_the_tree(spark):
    records = fixity.archive(pages_of(spark, 150), file_pages=50)
    leaf = fixity.leaves(records, fixity.index(records))
    levels = fixity.levels_for(leaf, range_bytes=700, fan=3)
    nodes = fixity.trees(leaf, levels, 700, 3)
    assert nodes.filter(F.col("level") == levels).groupBy("file").count().filter("count > 1").count() == 0
    assert nodes.groupBy("level", "file", "begin").count().filter("count > 1").count() == 0
    assert nodes.filter("level = 0").count() == leaf.count()


def test_empty_tables(spark):
    records = fixity.archive(pages_of(spark, 20), file_pages=50)
    none, places = records.limit(0), fixity.index(records)
    assert fixity.audit(none, none, places).count() == 0
    assert {r["kind"] for r in fixity.audit(records, none, places).collect()} == {"missing_b"}
    assert fixity.audit_pages(pages_of(spark, 20).limit(0)).count() == 0
