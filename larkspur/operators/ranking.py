"""Windows, top-k and histories. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import lists
from larkspur.sources.scratch import stored


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """WN1, WN2: 1-based position in the group, and whether it is the first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w).cast("long")).withColumn("first", F.col("position") == 1)


def gapless(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """``rows`` numbered from 0 without gaps, by ``order``, over all of them and not in one task.

    Ranges are sorted and numbered apart and written; what is before a range is a running total over a row for each range. Equal rows come in any order."""
    ranges = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_range", (before - F.col("_first")).alias("_shift"))
    return ranges.join(F.broadcast(shift), "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """OR3 to OR5: Spark keeps n rows in each task and merges those."""
    return rows.orderBy(*order).limit(n)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """OR6, WN4: Spark cuts each task's groups to n rows before they move."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def recents(views: DataFrame, user: str, item: str, ts: str, tie: str, keep: int = lists.KEEP) -> DataFrame:
    """WN3: each user's items by latest view, newest first, ``keep`` at most.

    The latest view of an item is a map-side combined maximum; only those are ranked."""
    latest = views.groupBy(user, item).agg(F.max(F.struct(ts, tie)).alias("_last")).select(user, item, F.col("_last")[ts].alias(ts), F.col("_last")[tie].alias(tie))
    return top_per_group(latest, [user], [F.desc(ts), F.desc(tie)], keep)


def returning(loads: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """WN5: whether the user had loaded a page before."""
    before = F.lag(ts).over(Window.partitionBy(user).orderBy(ts, tie))
    return loads.withColumn("returning", before.isNotNull())


def against_targets(metrics: DataFrame, targets: DataFrame, key: str = "metric") -> DataFrame:
    """WN6: value, target and what is missing for each metric."""
    return metrics.join(targets, key).withColumn("gap", F.col("target") - F.col("value")).withColumn("met", F.col("value") >= F.col("target"))


#: Fixed values of the worklist: positions, the least impressions and the click rate below which a title is worth a rewrite.
POSITIONS, IMPRESSIONS, CLICK_RATE = (5, 20), 50, 0.015


def worklist(pages: DataFrame, positions: tuple[float, float] = POSITIONS, impressions: int | None = IMPRESSIONS, rate: float = CLICK_RATE) -> DataFrame:
    """FL22, OR4: pages that rank within ``positions`` (both ends included) and are seen but hardly clicked.

    ``pages`` has position, impressions and clicks. ``impressions`` must be exceeded; with None they don't count. A page
    without impressions has no click rate and is left out, as is one whose position isn't known."""
    found = F.col("position").between(*positions) & (F.col("clicks") / F.nullif(F.col("impressions"), F.lit(0)) < rate)
    return pages.where(found if impressions is None else found & (F.col("impressions") > impressions))


def photos_first(reviews: DataFrame, order: list[Column], images: str = "images") -> DataFrame:
    """OR8"""
    return reviews.orderBy((F.size(F.coalesce(images, F.array())) > 0).desc(), *order)


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """OR9: each row so many times, numbered from 1."""
    return rows.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
