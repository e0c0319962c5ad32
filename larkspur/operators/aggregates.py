"""Aggregations of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_with_zero(members: DataFrame, collections: DataFrame, slug: str = "slug") -> DataFrame:
    """AG1: products of each collection; collections without any are there with 0."""
    return collections.select(slug).join(members.groupBy(slug).agg(F.count(F.lit(1)).alias("n")), slug, "left").select(slug, F.coalesce("n", F.lit(0)).alias("n_products"))


def ordered_text(rows: DataFrame, group: list[str], order: list[str], text: str, separator: str = "", name: str = "listing") -> DataFrame:
    """AG2: texts of a group joined in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(items, lambda x: x["_text"]), separator).alias(name))


def rating_summary(reviews: DataFrame, key: str, rating: str, stars: range = range(1, 6)) -> DataFrame:
    """AG4, AG5: count, mean to one place, and the share in per cent of every star, empty ones included."""
    share = [(F.sum(F.when(F.col(rating) == k, 1).otherwise(0)) * 100 / F.count(rating)).alias(f"pct_{k}") for k in stars]
    return reviews.where(F.col(rating).isNotNull()).groupBy(key).agg(F.count(rating).alias("n_reviews"), F.round(F.avg(rating), 1).alias("rating"), *share)


def subtotal(lines: DataFrame, cart: str, price: Column, qty: Column) -> DataFrame:
    """AG6"""
    return lines.groupBy(cart).agg(F.sum(price * qty).alias("subtotal"))


def not_exactly_one(rows: DataFrame, key: str, flag: Column) -> DataFrame:
    """AG9: keys that don't have exactly one flagged row."""
    return rows.groupBy(key).agg(F.count_if(flag).alias("n")).where(F.col("n") != 1)


def kpis(events: DataFrame, week: Column) -> DataFrame:
    """AG10: weekly figures; rates are ratios of sums, never means of ratios."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    out = events.groupBy(week.alias("week")).agg(
        of("view").alias("impressions"), of("click").alias("clicks"), of("purchase").alias("orders"), of("signup").alias("signups"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("revenue"), F.count_distinct("user_id").alias("visitors"),
    )
    rate = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return out.withColumns({"ctr": rate("clicks", "impressions"), "cvr": rate("orders", "clicks"), "aov": rate("revenue", "orders")})


def clicks_in_front(clicks: DataFrame, positions: DataFrame, url: str = "url", week: str = "week", low: float = 1, high: float = 10) -> DataFrame:
    """AG10: clicks a week on pages that stood at ``low`` to ``high``. ``positions`` has one row for a week and page."""
    counted = clicks.groupBy(week, url).agg(F.count(F.lit(1)).alias("_clicks"))  # before they meet, so a page much clicked is one row
    front = positions.where(F.col("position").between(low, high)).select(week, url)
    return counted.join(front, [week, url]).groupBy(week).agg(F.sum("_clicks").alias("clicks_in_front"))


def standing(changes: DataFrame, weeks: DataFrame, week: str = "week", change: str = "change", name: str = "standing") -> DataFrame:
    """How many there are at the end of each of ``weeks``: ``changes`` are summed a week, and only those sums, a row a week, are added up in order."""
    sums = changes.groupBy(week).agg(F.sum(change).alias("_sum")).unionByName(weeks.select(week, F.lit(0).cast("long").alias("_sum"))).groupBy(week).agg(F.sum("_sum").alias("_sum"))
    return sums.withColumn(name, F.sum("_sum").over(Window.orderBy(week).rowsBetween(Window.unboundedPreceding, 0))).drop("_sum").join(weeks.select(week).distinct(), week)


def list_size(signups: DataFrame, weeks: DataFrame, user: str, week: str = "week") -> DataFrame:
    """AG10: people on the list at the end of each week; one who signs up again is there already."""
    return standing(signups.groupBy(user).agg(F.min(week).alias(week)).select(week, F.lit(1).alias("change")), weeks, week, name="list_size")


def submitted(spans: DataFrame, weeks: DataFrame, week: str = "week") -> DataFrame:
    """AG10: addresses in the sitemaps at the end of each week. ``spans``: ``since`` and ``until`` (the week of removal, or null) of each address."""
    gone = spans.where(F.col("until").isNotNull()).select(F.col("until").alias(week), F.lit(-1).alias("change"))
    return standing(spans.select(F.col("since").alias(week), F.lit(1).alias("change")).unionByName(gone), weeks, week, name="submitted_urls")


def coverage(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """AG11: for each attribute how many rows have it and which share; one scan."""
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(a).alias(a) for a in attributes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("filled"), (F.col(a) / F.nullif(F.col("_n"), F.lit(0))).alias("share")) for a in attributes])).alias("x")).select("x.*")


def duplicate_copy(rows: DataFrame, text: Column) -> DataFrame:
    """AG12: normalised texts that occur more than once, by hash."""
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return rows.groupBy(F.sha2(norm.cast("binary"), 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
