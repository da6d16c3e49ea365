import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from estilens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8)
    # A cluster names this folder in spark.checkpoint.dir.
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over one row of literals."""
    from pyspark.sql import functions as F

    def run(build, *values):
        row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
        return row.select(build(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first()["r"]

    return run
