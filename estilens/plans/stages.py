"""Intermediate tables on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir (or a checkpoint folder set before)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root


def run_root(spark: SparkSession, root: str | None = None) -> str:
    """A folder of its own for the tables of one run, below the shared one: one folder to remove afterwards."""
    return f"{root or stage_root(spark)}/run-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The table outlives lost executors, cuts the lineage and lets each reader
    prune columns and row groups.  Every call writes a new folder.
    """
    spark = rows.sparkSession
    path = f"{root or stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
