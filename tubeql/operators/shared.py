"""Small tables that a plan uses again and again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set on the context too.

    Without that setting a temporary folder is made where driver and executors are one process (master local); on a
    cluster other executors couldn't read one, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tubeql-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is removed."""
    path = f"{shared_folder(spark).rstrip('/')}/tubeql-{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that it is computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
