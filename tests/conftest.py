import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tidemark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        # Not UTC on purpose: results must not depend on the session zone.
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def messages(spark):
    """Build a frame with event times given in epoch seconds."""

    def build(rows, schema):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "at double, " + schema)
        return df.withColumn("timestamp", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).drop("at")

    return build
