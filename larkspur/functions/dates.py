"""Business days, delivery verdicts, countdowns and seasons. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Business days to pack and in transit, least and most.
PACK, TRANSIT = (2, 3), (2, 6)
DAY_MS, HOUR_MS, MINUTE_MS = 86_400_000, 3_600_000, 60_000


def add_business_days(start: Column, n: int, holidays: Column | None = None) -> Column:
    """DT1: the n-th day after ``start`` that is no Saturday or Sunday (nor in the array ``holidays``, if given).

    Without holidays it is arithmetic: whole weeks, then the rest from the Monday-based weekday."""
    start = start.cast("date")
    if n == 0:
        return start
    if holidays is None:
        monday0 = F.weekday(start)
        # From a weekend, counting begins as if from the Friday before.
        base = F.when(monday0 > 4, F.date_sub(start, (monday0 - 4).cast("int"))).otherwise(start)
        day = F.least(monday0, F.lit(4))
        return F.date_add(base, (F.lit(n // 5 * 7 + n % 5) + F.when(day + n % 5 > 4, 2).otherwise(0)).cast("int"))
    days = F.sequence(F.date_add(start, 1), F.date_add(start, F.lit(2 * n + 4) + 2 * F.size(holidays)))
    return F.element_at(F.filter(days, lambda d: (F.weekday(d) < 5) & ~F.array_contains(holidays, d)), n)


def delivery(start: Column, holidays: Column | None = None) -> Column:
    """DT2: earliest and latest arrival."""
    soon, late = (add_business_days(start, p + t, holidays) for p, t in zip(PACK, TRANSIT, strict=True))
    return F.struct(soon.alias("soon"), late.alias("late"))


def verdict(soon: Column, late: Column, opener: Column) -> Column:
    """DT3"""
    return F.when(late < opener, "ok").when(soon < opener, "tight").otherwise("late")


def short_date(day: Column) -> Column:
    """DT4"""
    return F.date_format(day, "EEE, MMM d")


def countdown(left_ms: Column) -> Column:
    """DT5: whole days, hours and minutes left."""
    return F.struct(F.floor(left_ms / DAY_MS).alias("d"), F.floor(F.pmod(left_ms, F.lit(DAY_MS)) / HOUR_MS).alias("h"), F.floor(F.pmod(left_ms, F.lit(HOUR_MS)) / MINUTE_MS).alias("m"))


def days_left(left_ms: Column) -> Column:
    """DT6: days left, begun ones included."""
    return F.ceil(left_ms / DAY_MS)


def snooze_until(now_ms: Column, days: Column) -> Column:
    """DT7"""
    return now_ms + days * DAY_MS


def parse_instant(text: Column) -> Column:
    """DT8: ISO time with offset."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def in_season(day: Column, opens: Column, closes: Column) -> Column:
    """DT9: both ends included; a null end is open. A season over New Year simply closes in the next year."""
    return (day >= opens) & (closes.isNull() | (day <= closes))


def yearly_season(day: Column, open_month_day: str, close_month_day: str) -> Column:
    """A season by month and day (``MM-dd``) that comes every year, over New Year if it closes before it opens."""
    md = F.date_format(day, "MM-dd")
    if open_month_day <= close_month_day:
        return md.between(open_month_day, close_month_day)
    return (md >= open_month_day) | (md <= close_month_day)


def open_before(now: Column, opener: Column) -> Column:
    """FL26: still to come."""
    return now < opener
