"""Exact duplicates by skew-safe combining.

Equal texts are found in three stages, each of which compares whole texts:

- local: every task keeps one row for each text it reads (a partial aggregate by text);
- salted: these rows meet by digest, salt and text.  A digest that holds more than
  1/PARTS of all rows or bytes is hot and has SALTS salts, so that its rows from many
  tasks meet in many places; the rows of any other digest meet in one place;
- global: of a hot digest the winners of its salts, at most SALTS per text, meet again.

Texts are shuffled once.  Which digests are hot is counted on a written table of
digests without texts, from which the documents also learn their class at the end: by
digest, where a digest stands for one text.  Hot digests, at most 2 * PARTS by their
definition, are sent to all executors, so no join holds a hot group.  A digest under
which two different texts stand (none is known for SHA-256) is settled by its texts.

Defined results: a null text is an empty one; texts are equal if all their bytes are;
of equal texts the largest doc_id stays, a null one only if there is no other; rows
with the same doc_id and text count one by one in group_size, are all marked alike in
the report, and keep_one leaves one of them; an empty table gives an empty result.
Only doc_id and text are read by the report, so other columns cannot clash; keep_one
returns all columns as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estilens.llm.common import staged

#: A digest is hot if it has more than this part of all rows, or of all bytes.
PARTS = 4096
#: Places where the rows of a hot digest meet before its winners do.
SALTS = 64
DIGEST_BYTES = 32


def content(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def digest_of(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def hot_digests(members: DataFrame, parts: int = PARTS) -> DataFrame:
    """members(digest, n_bytes), written -> (digest): at most 2 * parts of them."""
    rows, size = members.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    groups = members.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    return staged(groups.filter((F.col("n") * parts > rows) | (F.col("n_bytes") * parts > (size or 0))).select("digest"), "exact-hot")


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key, with the largest id and the number of documents."""
    return rows.groupBy(*keys).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def _texts(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """Documents as rows (doc_id, text, sha, digest)."""
    rows = docs.select("doc_id", content(F.col("text")).alias("text")).withColumn("sha", digest_of(F.col("text")))
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes))


def classes(docs: DataFrame, hot: DataFrame, salts: int = SALTS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(digest, hot, keep_id, n): one row for each distinct text."""
    rows = _texts(docs, digest_bytes).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    # A task's rows of one text have one salt, so the partial aggregate leaves one of them.
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts)))
    rows = rows.select("digest", salt.alias("salt"), "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"))
    winners = _combined(rows, "digest", "salt", "text")
    # Only texts of hot digests meet again, so only they are written.
    winners = staged(winners.withColumn("text", F.when(F.col("salt").isNotNull(), F.col("text"))), "exact-winners")
    last = _combined(winners.filter("salt IS NOT NULL"), "digest", "text")
    columns = ("digest", "hot", "keep_id", "n")
    return winners.filter("salt IS NULL").withColumn("hot", F.lit(False)).select(*columns).union(last.withColumn("hot", F.lit(True)).select(*columns))


def duplicates(docs: DataFrame, parts: int = PARTS, salts: int = SALTS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    members = staged(_texts(docs, digest_bytes).select("doc_id", "sha", "digest", F.octet_length("text").alias("n_bytes")), "exact-members")
    hot = hot_digests(members, parts)
    found = classes(docs, hot, salts, digest_bytes)
    known = staged(
        found.groupBy("digest", "hot").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("n").alias("group_size")),
        "exact-classes",
    )
    lone = known.filter("texts = 1").drop("texts")
    columns = ("doc_id", "keep_id", "group_size", "sha")
    spread = members.join(F.broadcast(lone.filter("hot")), "digest").select(*columns)  # at most 2 * parts digests
    others = members.join(F.broadcast(hot), "digest", "left_anti").join(lone.filter("NOT hot"), "digest").select(*columns)
    out = spread.union(others)
    shared = known.filter("texts > 1").select("digest")
    if not shared.isEmpty():  # different texts under one digest
        rows = _texts(docs, digest_bytes).join(shared, "digest", "left_semi")
        each = rows.select("text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
        settled = _combined(_combined(each, "text", "salt"), "text").withColumnRenamed("n", "group_size")
        out = out.union(rows.join(settled, "text").select(*columns))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One document of each text, with all its columns."""
    kept = duplicates(docs, **settings).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    sha = F.lower(F.hex(digest_of(content(F.col("text"))))).alias("sha")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), sha)
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi").dropDuplicates(["id", "sha"])
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
