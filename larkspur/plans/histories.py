"""Histories of visitors over ``events``: views of items (``props.k``), page loads, popup actions. Each batch query is the twin of a stream.

Where a row depends on the visitor's earlier rows (windows by visitor), one visitor's rows are sorted in one task: a bot with a
great share of all events should be filtered out before. Histories and first or last events are map-side combined instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import ranking
from larkspur.plans.registry import Tables, query

K = "(props->>'$.k')::BIGINT"


def _views(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", "event_id")


_LATEST = f"SELECT user_id, k, rank FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (SELECT user_id, {K} AS k, ts, event_id, row_number() OVER (PARTITION BY user_id, {K} ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'view') WHERE r = 1) WHERE rank <= 12"


@query("wn3_recently_viewed", _LATEST)
def recents(t: Tables) -> DataFrame:
    return ranking.recents(_views(t), "user_id", "k", "ts", "event_id").select("user_id", "k", "rank")


@query("fl24_history_without_current", f"SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS place FROM ({_LATEST}) WHERE rank > 1 QUALIFY place <= 4")
def shown(t: Tables) -> DataFrame:
    """What is shown of the history on the page viewed last: the four before it."""
    earlier = recents(t).where("rank > 1")
    return ranking.numbered(earlier, ["user_id"], [F.asc("rank")]).where("position <= 4").select("user_id", "k", F.col("position").alias("place"))


@query("wn5_returning_visits", "SELECT event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS returning FROM events")
def returning(t: Tables) -> DataFrame:
    return ranking.returning(t.events, "user_id", "ts", "event_id").select("event_id", "returning")


@query("ss1_recents_state", f"SELECT user_id, string_agg(k::VARCHAR, ',' ORDER BY rank) AS items FROM ({_LATEST}) GROUP BY user_id")
def recents_state(t: Tables) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("rank", "k")))
    return recents(t).groupBy("user_id").agg(F.array_join(F.transform(items, lambda x: x["k"].cast("string")), ",").alias("items"))


@query("ss2_seen_state", "SELECT user_id, max((epoch_us(ts) // 1000)) AS seen_ms, count(*) > 1 AS shown FROM events GROUP BY user_id")
def seen_state(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("seen_ms"), (F.count(F.lit(1)) > 1).alias("shown"))


@query(
    "ss3_popup_suppression",
    "SELECT event_id, coalesce((epoch_us(ts) // 1000) < (last_value(CASE WHEN event_type = 'signup' THEN (epoch_us(ts) // 1000) + 180 * 86400000::BIGINT WHEN event_type = 'error' THEN (epoch_us(ts) // 1000) + 7 * 86400000::BIGINT END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), FALSE) AS suppressed FROM events",
)
def suppression(t: Tables) -> DataFrame:
    """Whether the popup is suppressed at each event: a signup snoozes 180 days, a dismissal (``error``) 7; the last one wins."""
    from pyspark.sql import Window

    now = F.unix_millis(F.col("ts").cast("timestamp"))
    until = F.when(F.col("event_type") == "signup", now + 180 * 86_400_000).when(F.col("event_type") == "error", now + 7 * 86_400_000)
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.coalesce(now < F.last(until, ignorenulls=True).over(before), F.lit(False)).alias("suppressed"))


@query("ss4_fire_once", "SELECT user_id, min((epoch_us(ts) // 1000)) AS fired_ms FROM (SELECT user_id, ts, value, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS elapsed FROM events) WHERE value >= 15 AND elapsed >= 5000 GROUP BY user_id")
def fire_once(t: Tables) -> DataFrame:
    """When each visitor's popup opens: the first event with enough scroll after the delay."""
    ms = t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")
    first = ms.groupBy("user_id").agg(F.min("ms").alias("first"))
    return ms.join(first, "user_id").where((F.col("value") >= 15) & (F.col("ms") - F.col("first") >= 5000)).groupBy("user_id").agg(F.min("ms").alias("fired_ms"))


@query("ss4_open_after_delay", "SELECT user_id, min((epoch_us(ts) // 1000)) + 5000 AS fired_ms FROM events GROUP BY user_id HAVING min((epoch_us(ts) // 1000)) + 5000 < (SELECT max((epoch_us(ts) // 1000)) - 3600000 FROM events)")
def open_after_delay(t: Tables) -> DataFrame:
    """When each visitor's popup opens if no scrolling is asked for: the delay after the first event, whether or not another one
    comes; as far as the time that has certainly passed (the latest event less an hour)."""
    ms = t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    passed = ms.agg((F.max("ms") - 3_600_000).alias("passed"))
    return ms.groupBy("user_id").agg((F.min("ms") + 5000).alias("fired_ms")).crossJoin(F.broadcast(passed)).where("fired_ms < passed").select("user_id", "fired_ms")


@query("ss5_self_hiding", "SELECT event_id, ts >= TIMESTAMP '2024-01-20 00:00:00' AS hidden FROM events")
def hiding(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).alias("hidden"))


@query("ss6_no_state_nothing_shown", "SELECT c_custkey, FALSE AS shown FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT user_id, count(*) > 1 FROM events GROUP BY user_id")
def no_state(t: Tables) -> DataFrame:
    seen = seen_state(t).select(F.col("user_id").alias("c_custkey"), "shown")
    everyone = t.customer.select("c_custkey").unionByName(seen.select("c_custkey")).distinct()
    return everyone.join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("shown", F.lit(False)).alias("shown"))
