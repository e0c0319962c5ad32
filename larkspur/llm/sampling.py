"""Bounded samples for fitting classifiers, the same for the same rows in any order and partitioning."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a row of fold 1 is held out. A null id is of fold -1 and held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(-1))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 1


def order(*keys: Column) -> Column:
    """A pseudo-random order of rows by their keys."""
    return F.xxhash64(F.lit("sample"), *keys)


def first_by_hash(rows: DataFrame, doc_id: str, bound: int) -> DataFrame:
    """``bound`` rows at most, evenly spread over all of them: a documented bound on what is collected for fitting."""
    rest = [c for c in rows.columns if c != doc_id]
    return rows.where(F.col(doc_id).isNotNull()).orderBy(order(F.col(doc_id)), doc_id, *rest).limit(bound)


def labelled_texts(rows: DataFrame, bound: int, most_bytes: int) -> list[tuple]:
    """(label, text) of at most ``bound`` different rows (_d, _y, _t), ``most_bytes`` of text in all, sorted by all three.

    Each label has an equal part of the bytes, used up in the order of a hash of id and text; a text that doesn't fit into
    what is left is passed over, but a label's first one stays if it fits into ``most_bytes``. However often a row
    or an id is repeated, only ``bound`` rows without texts and the chosen texts reach the driver."""
    known = rows.select("_d", "_y", "_t", F.xxhash64("_t").alias("_h"))
    small = known.select("_d", "_y", "_h", F.octet_length("_t").alias("_s")).distinct()
    found = small.orderBy(order(F.col("_d"), F.col("_h")), "_d", "_y", "_h", "_s").limit(bound).collect()
    if not found:
        return []
    part = most_bytes // len({r["_y"] for r in found})
    used: dict = defaultdict(int)
    chosen = []
    for r in found:
        if used[r["_y"]] + r["_s"] <= (part if used[r["_y"]] else most_bytes):
            used[r["_y"]] += max(1, r["_s"])
            chosen.append((r["_d"], r["_y"], r["_h"]))
    picked = rows.sparkSession.createDataFrame(chosen, small.select("_d", "_y", "_h").schema)
    whole = known.join(F.broadcast(picked), ["_d", "_y", "_h"]).groupBy("_d", "_y", "_h").agg(F.min("_t").alias("_t"))
    return [(r["_y"], r["_t"]) for r in sorted(whole.collect(), key=lambda r: (r["_d"], r["_y"], r["_t"]))]
