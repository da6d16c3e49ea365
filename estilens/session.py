"""Session settings the operators are tuned with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffles and splits skewed joins; the fallback limit
# keeps aggregates with text or set state hashed instead of sorting their input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # HotSpot does not compile methods above 8000 bytes of bytecode; without this
    # limit Spark would run such generated stages in the interpreter.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call sites of column expressions are looked up and sent to the JVM one by one
    # otherwise, which takes longer than a small review itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("estilens")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cpus),
        # The test tables are small: let files and shuffles of a few hundred
        # kilobytes still spread over the cores.
        "spark.sql.files.openCostInBytes": "65536",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
