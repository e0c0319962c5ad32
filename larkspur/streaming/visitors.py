"""Keyed visitor state as Structured Streaming (``transformWithState``). Each function has a batch twin in ``larkspur.plans.histories``.

State is typed: a list of views, the first load, the actions that may still matter; each bounded. Results go by event time
(ts, then id), whichever micro-batch an event comes in. Where an event that comes late changes what was said of another one, that
one is put out again: the output is an update stream, the last row for an event or visitor holds. Times are event times, the present is
never the clock's; timers go by the watermark. Only what a state store forgets of visitors who never come back (``TTL_MS``) goes by the clock.

Such queries need Spark's RocksDB state store; ``runs`` sets it for the streams that it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from larkspur.functions.lists import KEEP

#: How long a popup stays away after a dismissal and after a signup, and its delay.
SNOOZE_MS, SIGNED_MS, DELAY_MS = 7 * 86_400_000, 180 * 86_400_000, 5000
TTL_MS = 400 * 86_400_000
WATERMARK = "1 hour"


def read_events(spark: SparkSession, folder: str, schema: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """A folder of event files as a stream; times become instants (UTC), which watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


class _Keyed(StatefulProcessor):
    """A processor with its handle and no more to close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass


class Recents(_Keyed):
    """The latest view of each of the ``keep`` items viewed last; exact in any order of arrival, as an item's latest view only moves on."""

    def __init__(self, key: str, keep: int):
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.views = handle.getListState("views", "item string, ms long, id long", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        latest = {item: (ms, i) for item, ms, i in self.views.get()} if self.views.exists() else {}
        for r in rows:
            latest[r.item] = max(latest.get(r.item, (r.ms, r.id)), (r.ms, r.id))
        kept = sorted(latest.items(), key=lambda x: x[1], reverse=True)[: self.keep]
        self.views.put([(item, ms, i) for item, (ms, i) in kept])
        yield Row(**{self.key: key[0], "items": ",".join(item for item, _ in kept)})


class Returning(_Keyed):
    """The first load of a visitor; a load is a return if it isn't that. An earlier one that comes late takes its place."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "ms long, id long", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = tuple(self.first.get()) if self.first.exists() else None
        loads = {(r.ms, r.id) for r in rows}
        first = min(loads | ({before} if before else set()))
        self.first.update(first)
        for ms, i in sorted(loads | ({before} if before and before != first else set())):
            yield Row(**{self.key: key[0], "event_id": i, "returning": (ms, i) != first})


class Suppression(_Keyed):
    """What the last action before the watermark says (``until``), and the events since then, whose order may still change."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "until_ms long, timer_ms long")
        self.open = handle.getListState("open", "ms long, id long, lasts_ms long, suppressed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        settled, timer = self.until.get() if self.until.exists() else (0, None)
        events = {(ms, i): (lasts, said) for ms, i, lasts, said in self.open.get()} if self.open.exists() else {}
        events |= {(r.ms, r.id): (r.lasts_ms, None) for r in rows}
        passed, until, held = timerValues.getCurrentWatermarkInMs(), settled, []
        for (ms, i), (lasts, said) in sorted(events.items()):
            if (ms < until) != said:
                yield Row(**{self.key: key[0], "event_id": i, "suppressed": ms < until})
            held.append((ms, i, lasts, ms < until))
            until = until if lasts is None else ms + lasts
            if ms <= passed:
                settled, held = until, []
        self.open.put(held) if held else self.open.clear()
        # Once the watermark is beyond the snooze and all events, no state says the same as this state.
        over = max([until, *[ms for ms, _ in events]]) + 1
        if timer is not None and timer != over:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(over)
        self.until.update((settled, over))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        self.open.clear()
        return iter(())


class FireOnce(_Keyed):
    """The first load and whether the popup has opened: that can't be taken back, so an event that comes late changes nothing then."""

    def __init__(self, key: str, least_percent: float, delay_ms: int):
        self.key, self.least, self.delay = key, least_percent, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "first_ms long, fired boolean", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first, fired = self.state.get() if self.state.exists() else (None, False)
        scrolls = sorted((r.ms, r.percent) for r in rows if r.ms is not None)
        first = min([ms for ms, _ in scrolls] + ([first] if first is not None else []))
        opened = None if fired else next((ms for ms, p in scrolls if p is not None and p >= self.least and ms - first >= self.delay), None)
        if opened is not None:
            yield Row(**{self.key: key[0], "fired_ms": opened})
        self.state.update((first, fired or opened is not None))


class FireAfter(_Keyed):
    """The first load, with a timer after the delay; an earlier load that comes before the watermark has passed moves the timer."""

    def __init__(self, key: str, delay_ms: int):
        self.key, self.delay = key, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "first_ms long, last_ms long, fired boolean, timer_ms long")

    def _wait(self, first: int, last: int, fired: bool, timer: int | None) -> None:
        at = last + TTL_MS if fired else first + self.delay
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.state.update((first, last, fired, at))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        times = [r.ms for r in rows]
        first, last, fired, timer = self.state.get() if self.state.exists() else (min(times), max(times), False, None)
        self._wait(first if fired else min(first, *times), max(last, *times), fired, timer)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        first, last, fired, _ = self.state.get()
        if fired:
            self.state.clear()
        else:
            self._wait(first, last, True, None)
            yield Row(**{self.key: key[0], "fired_ms": first + self.delay})


def _slim(events: DataFrame, key: str, *columns: Column) -> DataFrame:
    """What a processor reads of an event: its key, time and more; an event without key or time is nobody's."""
    return events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "ts", F.unix_millis("ts").alias("ms"), *columns)


def recents(views: DataFrame, key: str = "user_id", item: str = "k", tie: str = "event_id", keep: int = KEEP) -> DataFrame:
    """SS1: each visitor's history after a micro-batch: items by latest view, newest first, joined by commas. Views of no item count for nothing."""
    rows = _slim(views.where(F.col(item).isNotNull()), key, F.col(item).cast("string").alias("item"), F.col(tie).alias("id"))
    return rows.groupBy(key).transformWithState(Recents(key, keep), f"{key} long, items string", "update", "ProcessingTime")


def returning(loads: DataFrame, key: str = "user_id", tie: str = "event_id") -> DataFrame:
    """SS2, SS6: for each load whether the visitor had loaded before; no state means no."""
    return _slim(loads, key, F.col(tie).alias("id")).groupBy(key).transformWithState(Returning(key), f"{key} long, event_id long, returning boolean", "update", "ProcessingTime")


def suppression(actions: DataFrame, key: str = "user_id", action: str = "event_type", tie: str = "event_id", dismissed: str = "error", signed: str = "signup") -> DataFrame:
    """SS3: whether the popup is suppressed at each event; the latest action's snooze holds. Events later than the watermark are dropped."""
    lasts = F.when(F.col(action) == signed, F.lit(SIGNED_MS)).when(F.col(action) == dismissed, F.lit(SNOOZE_MS)).cast("long")
    rows = _slim(actions.withWatermark("ts", WATERMARK), key, F.col(tie).alias("id"), lasts.alias("lasts_ms"))
    return rows.groupBy(key).transformWithState(Suppression(key), f"{key} long, event_id long, suppressed boolean", "update", "EventTime")


def fire_once(scrolls: DataFrame, key: str = "user_id", percent: str = "value", least_percent: float = 15.0, delay_ms: int = DELAY_MS) -> DataFrame:
    """SS4: one row for each visitor, at the first event with enough scroll after the delay."""
    rows = _slim(scrolls, key, F.col(percent).cast("double").alias("percent"))
    return rows.groupBy(key).transformWithState(FireOnce(key, least_percent, delay_ms), f"{key} long, fired_ms long", "update", "ProcessingTime")


def fire_after(loads: DataFrame, key: str = "user_id", delay_ms: int = DELAY_MS) -> DataFrame:
    """SS4 without scrolling: one row for each visitor, ``delay_ms`` after the first event, by an event-time timer.

    No further event of the visitor is needed: the timer goes off when the watermark, which all visitors' events move, has passed it."""
    rows = _slim(loads.withWatermark("ts", WATERMARK), key)
    return rows.groupBy(key).transformWithState(FireAfter(key, delay_ms), f"{key} long, fired_ms long", "update", "EventTime")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = WATERMARK) -> DataFrame:
    """Counts of events by type in tumbling windows; late events beyond the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
