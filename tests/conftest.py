import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tritempo.session import local_session

    session = local_session("tests", os.environ.get("TEST_CPUS", "8"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def ntz_frame(spark, rows, schema):
    """Rows with datetimes in timestamp_ntz columns."""
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def physical_plan():
    """Text of the physical plan of a DataFrame."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


def partition_sizes(spark, df):
    """Rows of each partition of a shuffle into eight; small partitions are not joined for it."""
    from pyspark.sql import functions as F

    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        return [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
