"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (tests), a local one.

    Reads the session's setting first and never overrides it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove_quietly, spark, path.rsplit("/", 1)[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone already at exit
        pass


class Stash:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def save(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """Write ``df`` as Parquet and read it back; also returns its folder, for :meth:`drop`."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        """Delete a table that no later plan reads."""
        remove(self.spark, path.rsplit("/", 1)[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's reader alone: ``sf_dir`` can be in any store that Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
