import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A DataFrame from ``{name: list}`` and a schema string."""

    def make(columns, schema, partitions=3):
        rows = list(zip(*columns.values()))
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


def dicts(df):
    return [r.asDict() for r in df.collect()]
