import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("counterfoil-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """A string table from column names and rows."""

    def build(names, rows):
        columns = names.split()
        return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))

    return build


@pytest.fixture
def apply(spark):
    """The values of a column function over a list of texts."""

    def run(function, values, kind="string"):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
        return [row[0] for row in df.orderBy("i").select(function(df["c"])).collect()]

    return run
