"""SS5: blocks that hide after their date without an event of their own: the clock is a stream, the blocks are a static table.

Every micro-batch reads the blocks again and puts out those whose date has come since the micro-batch before; what is put
out is a table by batch number, with the time up to which it holds, so a batch that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "block string, hidden_at timestamp, batch long"
EVERY = "30 seconds"


def clock(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """The time of day as a stream, column ``now``; ticks missed while nothing ran are made up for."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("timestamp").alias("now"))


def start(ticks: DataFrame, blocks: Callable[[], DataFrame], folder: str, every: str | None = EVERY) -> StreamingQuery:
    """Begin to hide: ``ticks`` has ``now``, ``blocks()`` has ``block`` and ``hides_at`` (never: null) as they are then.

    ``every``: the trigger's interval; None takes the ticks that there are and ends. A tick that is older than one before changes nothing."""
    spark = ticks.sparkSession

    def tick(batch: DataFrame, number: int) -> None:
        times = f"{folder}/times"
        past = spark.read.schema("now timestamp, batch long").parquet(times).where(F.col("batch") < number) if number else None
        before = past.agg(F.max("now")).first()[0] if past is not None else None
        latest = batch.agg(F.max("now")).first()[0]
        now = max(x for x in (before, latest) if x is not None) if before or latest else None
        due = blocks().where(F.col("hides_at") <= F.lit(now)) if now else blocks().limit(0)
        due = due.where(F.col("hides_at") > F.lit(before)) if before else due
        if before:  # a block that is new, with a date already past, is due as well
            hidden = spark.read.schema(SCHEMA).parquet(f"{folder}/hidden").where(F.col("batch") < number).select("block")
            due = due.unionByName(blocks().where(F.col("hides_at") <= F.lit(before))).join(hidden, "block", "left_anti")
        due.select(F.col("block").cast("string").alias("block"), F.lit(now).cast("timestamp").alias("hidden_at")).distinct().write.mode("overwrite").parquet(f"{folder}/hidden/batch={number}")
        spark.createDataFrame([(now,)], "now timestamp").write.mode("overwrite").parquet(f"{times}/batch={number}")

    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def hidden(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks hidden so far, each with the time of the tick that hid it."""
    return spark.read.schema(SCHEMA).parquet(f"{folder}/hidden").groupBy("block").agg(F.min("hidden_at").alias("hidden_at"))
