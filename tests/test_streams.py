"""Streams over several micro-batches against the batch twins."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.plans import histories
from larkspur.plans.registry import Tables
from larkspur.plans.streams import EVENTS
from larkspur.streaming import runs, visitors


@pytest.fixture(scope="module")
def split_events(spark, sf_dir, tmp_path_factory):
    """The events cut into files by time."""
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").toPandas()
    for k in range(5):
        part = rows.iloc[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        part.to_parquet(folder / f"e{k}.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(folder / f"e{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def stream(spark, folder):
    return visitors.read_events(spark, folder, EVENTS, "*.parquet", 1)


def test_recents(spark, sf_dir, split_events):
    views = stream(spark, split_events).where("event_type = 'view'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = runs.available_now(visitors.recents(views), idle=False)
    assert rows.agg(F.max("batch")).first()[0] >= 4
    assert sorted(map(tuple, runs.latest(rows, "user_id").collect())) == sorted(map(tuple, histories.recents_state(Tables(spark, sf_dir)).collect()))


def test_suppression(spark, sf_dir, split_events):
    rows = runs.available_now(visitors.suppression(stream(spark, split_events)))
    assert sorted(map(tuple, runs.latest(rows, "event_id").select("event_id", "suppressed").collect())) == sorted(map(tuple, histories.suppression(Tables(spark, sf_dir)).collect()))


def test_returning_and_fire_once(spark, sf_dir, split_events):
    rows = runs.available_now(visitors.returning(stream(spark, split_events)), idle=False)
    assert sorted(map(tuple, rows.select("event_id", "returning").collect())) == sorted(map(tuple, histories.returning(Tables(spark, sf_dir)).collect()))
    fired = runs.available_now(visitors.fire_once(stream(spark, split_events)), idle=False)
    assert sorted(map(tuple, fired.select("user_id", "fired_ms").collect())) == sorted(map(tuple, histories.fire_once(Tables(spark, sf_dir)).collect()))


BASE = 1_700_000_000_000
MINUTE = 60_000


def write(folder, number, rows):
    """A file of events (visitor, id, minutes after BASE, type), taken by the stream after those with smaller numbers."""
    frame = pd.DataFrame([(i, pd.Timestamp(BASE + int(m * MINUTE), unit="ms"), v, kind, 50.0, f'{{"k": {i % 4}}}') for v, i, m, kind in rows], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.to_parquet(f"{folder}/e{number}.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    os.utime(f"{folder}/e{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def held(rows, key):
    return sorted(map(tuple, runs.latest(rows, key).drop("user_id").collect()))


def test_results_go_by_event_time_whatever_the_order_of_arrival(spark, tmp_path):
    """A signup that comes late suppresses what came after it; the first load comes last; ties go by id."""
    write(tmp_path, 0, [(1, 3, 30, "view"), (1, 4, 40, "view"), (2, 10, 5, "error")])
    write(tmp_path, 1, [(1, 2, 35, "signup"), (2, 11, 6, "view"), (1, 6, 40, "view")])
    write(tmp_path, 2, [(1, 1, 10, "view"), (1, 5, 40, "error"), (2, 9, 5, "view")])
    suppressed = runs.available_now(visitors.suppression(stream(spark, str(tmp_path))))
    assert held(suppressed, "event_id") == [(1, False), (2, False), (3, False), (4, True), (5, True), (6, True), (9, False), (10, False), (11, True)]
    assert suppressed.where("event_id = 4").count() == 2  # said again, as it changed
    back = runs.available_now(visitors.returning(stream(spark, str(tmp_path))), idle=False)
    assert held(back, "event_id") == [(i, i not in (1, 9)) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)]
    views = stream(spark, str(tmp_path)).withColumn("k", F.get_json_object("props", "$.k"))
    lists = runs.latest(runs.available_now(visitors.recents(views), idle=False), "user_id")
    assert sorted(map(tuple, lists.collect())) == [(1, "2,1,0,3"), (2, "3,2,1")]


def test_a_run_goes_on_where_the_last_one_ended(spark, tmp_path):
    """State, output and checkpoint outlive the query: a second run over the same folder reads the new files alone."""
    folder, at = tmp_path / "in", {k: str(tmp_path / k) for k in ("s", "r", "v", "f")}
    folder.mkdir()

    def run():
        rows = stream(spark, str(folder))
        views = rows.withColumn("k", F.get_json_object("props", "$.k"))
        return (
            runs.available_now(visitors.suppression(rows), at=at["s"]), runs.available_now(visitors.returning(rows), at=at["r"], idle=False),
            runs.available_now(visitors.recents(views), at=at["v"], idle=False), runs.available_now(visitors.fire_once(rows), at=at["f"], idle=False),
        )

    write(folder, 0, [(1, 1, 0, "signup"), (2, 2, 0, "view")])
    first = run()
    assert held(first[0], "event_id") == [(1, False), (2, False)] and first[3].count() == 0
    write(folder, 1, [(1, 3, 90, "view"), (2, 4, 90, "view")])
    write(folder, 2, [(1, 5, 300 * 24 * 60, "view")])
    suppressed, back, lists, fired = run()
    assert held(suppressed, "event_id") == [(1, False), (2, False), (3, True), (4, False), (5, False)]
    assert held(back, "event_id") == [(1, False), (2, False), (3, True), (4, True), (5, True)]
    assert dict(map(tuple, runs.latest(lists, "user_id").collect())) == {1: "1,3", 2: "0,2"}
    assert sorted(map(tuple, fired.select("user_id", "fired_ms").collect())) == [(1, BASE + 90 * MINUTE), (2, BASE + 90 * MINUTE)]
    assert back.where("event_id in (1, 2)").select("batch").distinct().count() == 1  # not read again


def test_an_earlier_load_moves_the_timer(spark, tmp_path):
    write(tmp_path, 0, [(1, 1, 30, "view")])
    write(tmp_path, 1, [(1, 2, 20, "view"), (2, 3, 25, "view")])
    write(tmp_path, 2, [(9, 4, 300, "view")])
    fired = runs.available_now(visitors.fire_after(stream(spark, str(tmp_path))))
    assert sorted(map(tuple, fired.select("user_id", "fired_ms").collect())) == [(1, BASE + 20 * MINUTE + 5000), (2, BASE + 25 * MINUTE + 5000)]


def test_settings_of_the_session_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in (runs._STORE, runs._IDLE)}
    with runs.typed_state(spark, idle=False):
        assert spark.conf.get(runs._IDLE) == "false"
    assert {k: spark.conf.get(k, None) for k in before} == before
