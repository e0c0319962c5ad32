"""Running a stream over what there is, into a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.scratch import scratch

_STORE, _IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def typed_state(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed state needs; the session's settings come back afterwards.

    ``idle``: whether micro-batches without data are run. Event-time timers need one at the end; with state that expires by
    the clock Spark asks for another one for ever, so that a stream over what there is would never end."""
    settings = {_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _IDLE: str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def available_now(stream: DataFrame, mode: str = "update", at: str | None = None, idle: bool = True) -> DataFrame:
    """All output of a stream over the data that is there now, with the number of the micro-batch it came from.

    Batches are written by their number, so a batch that is run again replaces itself. ``at``: a folder that holds output and
    checkpoint of earlier runs, which this one goes on from; without it a run is one of its own."""
    spark = stream.sparkSession
    folder = at or scratch(spark, "run")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with typed_state(spark, idle):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last output for each key."""
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")
