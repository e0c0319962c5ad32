"""Blocks that hide by a clock alone."""

import datetime as dt
import os
import time

import pandas as pd
from pyspark.sql import functions as F

from larkspur.streaming import recompute

DAY = dt.datetime(2026, 10, 1)


def test_blocks_hide_in_the_tick_after_their_date(spark, tmp_path):
    ticks, out = tmp_path / "ticks", str(tmp_path / "out")
    ticks.mkdir()
    rows = [("a", DAY), ("b", DAY + dt.timedelta(minutes=5)), ("c", DAY + dt.timedelta(minutes=6)), ("never", None), ("late", DAY + dt.timedelta(days=9))]

    def blocks():
        return spark.createDataFrame(rows, "block string, hides_at timestamp")

    def run():
        now = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(str(ticks))
        recompute.start(now, blocks, out, every=None).awaitTermination()
        return {r["block"]: r["hidden_at"] for r in recompute.hidden(spark, out).collect()}

    for k, minutes in enumerate([0, 5, 4]):  # the last one comes too late to change anything
        pd.DataFrame({"now": [DAY + dt.timedelta(minutes=minutes)]}).to_parquet(f"{ticks}/t{k}.parquet", coerce_timestamps="us")
        os.utime(f"{ticks}/t{k}.parquet", (1_700_000_000 + k,) * 2)
    first = run()
    assert first == {"a": DAY, "b": DAY + dt.timedelta(minutes=5)}
    rows.append(("new", DAY + dt.timedelta(minutes=1)))  # its date was over before it came
    pd.DataFrame({"now": [DAY + dt.timedelta(minutes=10)]}).to_parquet(f"{ticks}/t9.parquet", coerce_timestamps="us")
    assert run() == first | {"c": DAY + dt.timedelta(minutes=10), "new": DAY + dt.timedelta(minutes=10)}


def test_a_block_hides_while_nothing_happens(spark, tmp_path):
    """The clock of the day, a trigger by processing time."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    blocks = spark.createDataFrame([("soon", 4), ("later", 4000)], "block string, s int").select("block", (F.lit(now) + F.make_dt_interval(secs=F.col("s"))).cast("timestamp").alias("hides_at"))
    query = recompute.start(recompute.clock(spark), lambda: blocks, str(tmp_path), every="1 second")
    try:
        found = []
        for _ in range(40):
            time.sleep(1)
            assert query.exception() is None
            if os.path.isdir(f"{tmp_path}/hidden") and (found := [r["block"] for r in recompute.hidden(spark, str(tmp_path)).collect()]):
                break
        assert found == ["soon"]
    finally:
        query.stop()
