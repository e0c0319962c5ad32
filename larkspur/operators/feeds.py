"""SC8: a supplier's feed against the one before: what came, changed and went; only that is validated, and what fails is kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.tables import validate_feed


def changes(before: DataFrame, after: DataFrame, key: str = "sku") -> DataFrame:
    """``key`` and ``change`` (inserted, changed, removed) of rows that differ; rows that don't are left out.

    Rows meet by key with a hash of their other columns (by name), so one narrow exchange whatever the width of a feed. A repeated
    key must have equal rows, or it fails; a null key counts for nothing."""
    columns = sorted({*before.columns, *after.columns} - {key})

    def hashed(feed: DataFrame, name: str) -> DataFrame:
        values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in feed.columns else F.lit("\0") for c in columns]
        row = F.sha2(F.concat_ws("\1", *values).cast("binary"), 256)
        own = feed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias(name), F.max(row).alias("_max"))
        twice = F.raise_error(F.concat(F.lit("two rows of "), F.col(key).cast("string")))
        return own.withColumn(name, F.when(F.col(name) == F.col("_max"), F.col(name)).otherwise(twice)).drop("_max")

    met = hashed(before, "_old").join(hashed(after, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return met.select(key, change.alias("change")).where(F.col("change").isNotNull())


def imported(before: DataFrame, after: DataFrame, key: str = "sku") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue after an import, its log, and the quarantine.

    Log: ``key``, ``change`` and ``rejected``. A new row that breaks a domain stays out, a changed one leaves the row as it was before; the
    quarantine has such rows as they came, with ``faults``. Rows that didn't change aren't validated again."""
    diff = changes(before, after, key)
    touched = after.join(diff.where("change <> 'removed'").select(key), key, "left_semi").dropDuplicates([key])
    faults = validate_feed(touched).groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws("=", "attribute", "value"))).alias("faults"))
    quarantine = touched.join(faults, key)
    log = diff.join(faults.select(key, F.lit(True).alias("rejected")), key, "left").select(key, "change", F.coalesce("rejected", F.lit(False)).alias("rejected"))
    taken = touched.join(faults, key, "left_anti")
    gone = log.where("not rejected").select(key)
    return before.join(gone, key, "left_anti").unionByName(taken), log, quarantine
