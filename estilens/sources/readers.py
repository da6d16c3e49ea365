"""Parquet, CSV and literal sources."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from estilens.operators.periods import CURRENT
from estilens.plans.stages import run_root


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV file with a header.  Types come from the schema, never from the data."""
    return spark.read.schema(schema).csv(path, header=True)


def read_lookup(spark: SparkSession, path: str, schema: StructType, key: str, value: str) -> DataFrame:
    """Key and value columns of a CSV file, one row per key."""
    return read_csv(spark, path, schema).groupBy(key).agg(F.max(value).alias(value))


class Ingested(NamedTuple):
    """Rows of a file that fit its schema, and the lines that do not (file, record)."""

    rows: DataFrame
    rejects: DataFrame


def ingest_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, root: str | None = None) -> Ingested:
    """A CSV source read once, its lines dealt out to rows and rejects.

    A line is rejected if it has too few or too many fields, or a field that its
    column's type does not take; the line is kept as it stands, with the file's name.
    Both parts are written in one pass, so every line is in exactly one of them, and
    later reads see columns, not text.
    """
    bad = "_corrupt_record"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "columnPruning": "false", "enforceSchema": "true"}
    whole = StructType([*schema.fields, StructField(bad, StringType())])
    read = spark.read.schema(whole).options(**options).csv(path, header=header)
    at = f"{run_root(spark, root)}/csv"
    read.select("*", F.col("_metadata.file_path").alias("_file"), F.col(bad).isNull().alias("_fits")).write.partitionBy("_fits").parquet(at)
    stored = StructType([*whole.fields, StructField("_file", StringType()), StructField("_fits", BooleanType())])
    both = spark.read.schema(stored).parquet(at)
    return Ingested(
        both.filter("_fits").select(*schema.names),
        both.filter("NOT _fits").select(F.col("_file").alias("file"), F.col(bad).alias("record")),
    )


def with_file_place(rows: DataFrame, name: str = "file_place") -> DataFrame:
    """rows as read from files, with the place of each in them: file, block, row in the block.

    A block is read by one task from its beginning to its end, so row numbers within
    it grow in the order of the file, however many blocks a task reads and in
    whatever order; the places of one read compare with each other, and the order
    they give does not depend on how the files are split.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(name))


def read_vintage_partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All vintages of a table in one scan: files under <path>/vintage=<year or current>.

    The schema is that of the newest vintage.  Columns that older files lack are null,
    so a table may gain columns without being rewritten.  Vintage is a partition
    column: a join with the vintages that releases need drops the others at run time.
    """
    return spark.read.schema(StructType([*[f for f in schema.fields if f.name != "vintage"], StructField("vintage", StringType())])).parquet(path)


def read_vintages(spark: SparkSession, root: str, table: str, vintages: list[str]) -> DataFrame:
    """The stored vintages of a table, <table>_archive_<year> and <table>_current, as one
    table with a vintage column; columns are matched by name.

    A vintage that isn't there is an error when its folder is read.
    """
    def one(vintage: str) -> DataFrame:
        path = f"{root}/{table}_current" if vintage == CURRENT else f"{root}/{table}_archive_{vintage}"
        return spark.read.parquet(path).withColumn("vintage", F.lit(vintage))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(v) for v in vintages])


def read_models(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A model table and its one archive, <table>_current and <table>_archive, with a vintage column."""
    parts = [spark.read.parquet(f"{root}/{table}_{v}").withColumn("vintage", F.lit(v)) for v in ("archive", CURRENT)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
