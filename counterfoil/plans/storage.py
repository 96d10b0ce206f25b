"""Keeping an intermediate table that is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines reach.

    Where a single machine runs everything, its temporary folder does as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise SourceError("spark.checkpoint.dir must name a folder that all machines reach")
        folder = tempfile.mkdtemp(prefix="counterfoil-")
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """The rows as stored at ``path``: pruned when read, and there when executors are lost."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove what ``keep`` has stored."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
