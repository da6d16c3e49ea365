"""Fixity audit of WARC replicas by Merkle trees.

The records of a file, in the order of their offsets, are the leaves of a tree: a
record's hash is over its bytes.  Above them stand offset ranges: the lowest have
RANGE bytes, each upper one FAN lower ones, up to the root of the file.  A node's
hash is over its children's offsets and hashes.  Two replicas are compared from the
roots down: files with equal roots are done; of the others only the children of
nodes that differ are looked at, level by level, until the records that differ are
found.  A record that one replica lacks shows as missing in that one.

The number of levels follows from the longest file and is known before the descent;
each level is a join of nodes that differ with their children.  A node has at most
FAN children, and a lowest range at most as many records as fit into it, so no group
grows with the corpus, whatever the size of a file or of a host.  Bodies are hashed
where they are read and never shuffled.

Defined results: a null body has no bytes; several records of one name in a file
are hashed together, in the order of their hashes, and reported once; a file that one replica lacks is reported record by record; equal replicas
give no rows, as do empty tables.  Records are known by file, name and bytes; other
columns are not read, so they cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.llm.common import staged

RANGE, FAN = 1 << 16, 16
#: Pages of one file.
FILE_PAGES = 512


def warc_record(uri: Column, body: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The bytes of a WARC 1.1 resource record."""
    body = F.coalesce(body.cast("binary"), F.lit(b""))
    uri = F.coalesce(uri, F.lit(""))
    uuid = F.concat_ws("-", *[F.substring(record_id(uri, body), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def record_id(uri: Column, body: Column) -> Column:
    """A name that a record keeps, whatever happens to its bytes later."""
    return F.md5(F.concat(F.coalesce(uri, F.lit("")).cast("binary"), F.coalesce(body.cast("binary"), F.lit(b""))))


def archive(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """pages(page_id, url, html) -> (file, page_id, record, bytes): records of files of consecutive pages."""
    number = F.coalesce(F.floor(F.col("page_id") / file_pages), F.lit(-1)).cast("string")
    return pages.select(
        F.concat(F.lit("part-"), number, F.lit(".warc")).alias("file"), "page_id",
        record_id(F.col("url"), F.col("html")).alias("record"), warc_record(F.col("url"), F.col("html")).alias("bytes"),
    )


def index(records: DataFrame) -> DataFrame:
    """(file, record, begin): where each record of an archive begins, in the order of pages.

    Only sizes are summed; bodies stay where they are.  Equal records of a page
    stand behind each other, and one row has the place of all.
    """
    sizes = records.groupBy("file", "record").agg(
        F.min("page_id").alias("page_id"), F.sum(F.octet_length("bytes").cast("bigint")).alias("size")
    )
    before = Window.partitionBy("file").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "record", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"))


def leaves(replica: DataFrame, places: DataFrame) -> DataFrame:
    """(file, begin, size, hash) of each record of a replica.

    Records that the index lacks get places before the file's beginning.
    """
    hashed = replica.select(
        "file", "record", F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("bigint").alias("size"), F.sha2(F.coalesce("bytes", F.lit(b"")), 256).alias("hash")
    )
    outside = -1 - F.pmod(F.xxhash64("record"), F.lit(1 << 40))
    placed = hashed.join(places, ["file", "record"], "left").withColumn("begin", F.coalesce("begin", outside))
    several = F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), ","), 256)
    return placed.groupBy("file", "begin").agg(
        F.sum("size").alias("size"), F.when(F.count(F.lit(1)) == 1, F.min("hash")).otherwise(several).alias("hash")
    )


def _parents(nodes: DataFrame, width: int) -> DataFrame:
    """The ranges of a level from their children, (file, begin, hash)."""
    begin = (F.floor(F.col("begin") / width) * width).cast("bigint")
    children = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("begin", "hash"))), lambda c: F.concat_ws(":", c["begin"].cast("string"), c["hash"])
    ), ",")
    return nodes.groupBy("file", begin.alias("begin")).agg(F.sha2(children, 256).alias("hash"))


def trees(leaf: DataFrame, levels: int, range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """All nodes (level, file, begin, hash): level 0 has the records, the last one the roots."""
    out = nodes = leaf.select("file", "begin", "hash")
    out = out.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        nodes = _parents(nodes, range_bytes * fan ** (level - 1))
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out


def levels_for(*replicas: DataFrame, range_bytes: int = RANGE, fan: int = FAN) -> int:
    """Levels above the records, so that one range holds any file."""
    longest = max(((r.agg(F.max(F.col("begin") + F.col("size"))).first()[0] or 0) for r in replicas), default=0)
    return 1 + max(0, math.ceil(round(math.log(max(longest, 1) / range_bytes, fan), 9)))


def audit(a: DataFrame, b: DataFrame, places: DataFrame, range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """records(file, record, bytes) of two replicas and the index of their archive ->
    where they differ: file, begin, sizes and hashes in both, and kind (changed,
    missing_a, missing_b)."""
    a, b = staged(leaves(a, places), "leaves-a"), staged(leaves(b, places), "leaves-b")
    levels = levels_for(a, b, range_bytes=range_bytes, fan=fan)
    tree_a, tree_b = (staged(trees(r, levels, range_bytes, fan), name, by="level") for r, name in ((a, "tree-a"), (b, "tree-b")))

    def at(level: int, under: DataFrame | None) -> DataFrame:
        """Nodes of a level that differ, below those that differ above."""
        sides = []
        for tree, name in ((tree_a, "hash_a"), (tree_b, "hash_b")):
            nodes = tree.filter(F.col("level") == level).select("file", "begin", F.col("hash").alias(name))
            if under is not None:
                width = range_bytes * fan**level
                nodes = nodes.withColumn("above", (F.floor(F.col("begin") / width) * width).cast("bigint"))
                nodes = nodes.join(under, (nodes["file"] == under["u_file"]) & (nodes["above"] == under["u_begin"]), "left_semi").drop("above")
            sides.append(nodes)
        return sides[0].join(sides[1], ["file", "begin"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))

    differ = None
    for level in range(levels, -1, -1):
        differ = staged(at(level, differ), f"differ-{level}")
        if level:
            differ = differ.select(F.col("file").alias("u_file"), F.col("begin").alias("u_begin"))
    for leaf, name in ((a, "size_a"), (b, "size_b")):
        differ = differ.join(leaf.select("file", "begin", F.col("size").alias(name)), ["file", "begin"], "left")
    kind = F.when(F.col("hash_a").isNull(), "missing_a").when(F.col("hash_b").isNull(), "missing_b").otherwise("changed")
    return differ.select("file", "begin", "size_a", "size_b", "hash_a", "hash_b", kind.alias("kind"))


def decayed(records: DataFrame) -> DataFrame:
    """A second replica with known damage, for the query: of the records whose page_id
    has the remainder 7 by 50, one byte is another; those with 31 are lost."""
    rest = F.coalesce(F.pmod("page_id", F.lit(50)), F.lit(0))
    bad = F.concat(F.lit(b"WARC/1.0"), F.expr("substring(bytes, 9)"))
    return records.filter(rest != 31).withColumn("bytes", F.when(rest == 7, bad).otherwise(F.col("bytes")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Archive the pages, and audit a replica with known damage against the archive."""
    records = archive(pages)
    return audit(records, decayed(records), staged(index(records), "warc-index"))
