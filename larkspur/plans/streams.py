"""The visitor streams over ``events``, run over what there is; the SQL is that of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans import histories  # noqa: F401  registers the twins first
from larkspur.plans.registry import ORACLE_SQL, Tables, query
from larkspur.sources.scratch import scratch
from larkspur.streaming import recompute, runs, visitors

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(t: Tables) -> DataFrame:
    return visitors.read_events(t.spark, t.sf_dir, EVENTS)


@query("ss1_recents_stream", ORACLE_SQL["ss1_recents_state"])
def recents(t: Tables) -> DataFrame:
    views = _events(t).where("event_type = 'view'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return runs.latest(runs.available_now(visitors.recents(views), idle=False), "user_id")


@query("ss2_returning_stream", ORACLE_SQL["wn5_returning_visits"])
def returning(t: Tables) -> DataFrame:
    return runs.latest(runs.available_now(visitors.returning(_events(t)), idle=False), "event_id").select("event_id", "returning")


@query("ss3_suppression_stream", ORACLE_SQL["ss3_popup_suppression"])
def suppression(t: Tables) -> DataFrame:
    return runs.latest(runs.available_now(visitors.suppression(_events(t))), "event_id").select("event_id", "suppressed")


@query("ss4_fire_once_stream", ORACLE_SQL["ss4_fire_once"])
def fire_once(t: Tables) -> DataFrame:
    return runs.available_now(visitors.fire_once(_events(t)), idle=False).select("user_id", "fired_ms")


@query("ss4_open_after_delay_stream", ORACLE_SQL["ss4_open_after_delay"])
def open_after_delay(t: Tables) -> DataFrame:
    return runs.available_now(visitors.fire_after(_events(t))).select("user_id", "fired_ms")


@query("d_windowed_stream", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(t: Tables) -> DataFrame:
    rows = runs.available_now(visitors.windowed_counts(_events(t)))
    last = rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("ss5_hiding_stream", "SELECT p_partkey::VARCHAR AS block FROM part WHERE TIMESTAMP '2024-01-01' + to_hours(((p_partkey * 7 + p_size) % 1500)::BIGINT) <= (SELECT max(ts) FROM events)")
def hiding(t: Tables) -> DataFrame:
    """Blocks of products with a date each, hidden by a clock that the events' times move: no block has an event of its own."""
    date = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, CAST((p_partkey * 7 + p_size) % 1500 AS INT))")
    folder = scratch(t.spark, "hiding")
    ticks = _events(t).select(F.col("ts").alias("now"))
    recompute.start(ticks, lambda: t.part.select(F.col("p_partkey").cast("string").alias("block"), date.alias("hides_at")), folder, every=None).awaitTermination()
    return recompute.hidden(t.spark, folder).select("block")
