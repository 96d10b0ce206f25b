"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting (4.1) by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local one only where a single machine runs all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="counterfoil-llm-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Of what is written inside, no shuffle files stay: the table is read from then on.

    Else Spark frees them when the driver collects garbage, which a driver with little to do may put off for
    very long, and some may even then be held by what the driver did last.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet and read back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """The same rows as a table with buckets of a column, so that a join by it moves the other side only."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    with _freeing(spark):
        df.write.bucketBy(buckets, column).option("compression", "zstd").saveAsTable(name, format="parquet")
    return spark.table(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
