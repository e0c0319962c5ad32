"""A folder for round trips: below ``spark.checkpoint.dir``, which the driver and the executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    folder = f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str = "round") -> DataFrame:
    """``df`` written and read back: what follows doesn't compute it again, and lost executors lose none of it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already at exit
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
