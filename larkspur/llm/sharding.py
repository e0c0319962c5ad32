"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of (id, text checksum, size), nulls first; a keyed Feistel network permutes the
numbers 0 to N - 1 (numbers outside are walked along their cycle until they fall inside), and the permuted
number p gives shard ``p mod shards`` and slot ``p div shards``. So shards differ by one row at most (the law
``rows``), slots have no gaps, and both directions can be computed without a table: :meth:`Feistel.place` and
:meth:`Feistel.row`.

Numbering: rows that agree in id, checksum and size are counted together before anything moves (they are
interchangeable), bins between approximate quantiles of the ids give even pieces, and a row's number is its bin's
offset plus its place in the bin. An id that several quantiles fall on has as many bins of its own, by checksum. The bins only
deal out work: numbers don't depend on where the cuts are. The driver sees a count for each bin, a few times ``MOST_BINS`` at
most. Texts don't move.

Under this law equal texts (the groups of a corpus) aren't kept together: where a copy goes follows from its row number alone.
A null text has 8 bytes and the checksum of the empty text; texts of any length count with all their bytes. Rows with a
null id come first and are dealt over their own bins by checksum. Repeated rows, and rows that tie in all three, each have
a place. An empty table has no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_BIN, LEAST_BINS, MOST_BINS, LEAST_NULL_BINS = 50_000, 512, 8192, 64


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, seed: int, rounds: int = 6):
        if n < 1:
            raise ValueError("nothing to permute")
        self.n = n
        self.bits = max(1, math.ceil((n - 1).bit_length() / 2))
        self.keys = [(seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64 for r in range(rounds)]
        self.mask = np.uint64((1 << self.bits) - 1)

    def _round(self, half: np.ndarray, key: int) -> np.ndarray:
        x = half ^ np.uint64(key)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(33))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.bits), x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return left << np.uint64(self.bits) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.bits), x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._round(left, key), left
        return left << np.uint64(self.bits) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(x.astype(np.uint64))
        while (outside := np.flatnonzero(x >= self.n)).size:
            x[outside] = step(x[outside])
        return x.astype(np.int64)

    def permute(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def invert(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)

    def place(self, row: int, shards: int) -> tuple[int, int]:
        p = int(self.permute(np.array([row]))[0])
        return p % shards, p // shards

    def row(self, shard: int, slot: int, shards: int) -> int:
        return int(self.invert(np.array([slot * shards + shard]))[0])


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """Columns doc_id, text_crc32, size and the global row number ``row``; and how many rows there are."""
    counted = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("_n"))
    total, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    if not total:
        return counted.select("doc_id", "text_crc32", "size", F.lit(0).cast("long").alias("row")), 0
    bins = min(MOST_BINS, max(LEAST_BINS, total // ROWS_A_BIN))
    null_bins = min(MOST_BINS, max(LEAST_NULL_BINS, nulls // ROWS_A_BIN))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / bins for i in range(1, bins)], 100 * bins)).first()[0] or []
    cuts, own = np.unique(np.array(cuts, dtype=np.int64), return_counts=True)
    # Pieces of the ids from each cut on, and where they begin: those of an id that several cuts fall on, and one for the rest.
    pieces = np.append(1, np.where(own > 1, own + 1, 1))
    begin = null_bins + np.cumsum(pieces) - pieces

    @F.pandas_udf(T.IntegerType())
    def bin_of(doc_id: pd.Series, crc: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy(dtype=np.int64)
        at = np.searchsorted(cuts, ids, side="right")
        n = pieces[at] - 1
        hot = (n > 0) & (ids == cuts[at - 1]) if len(cuts) else np.zeros(len(ids), dtype=bool)
        return pd.Series((begin[at] + np.where(hot, crc.to_numpy(dtype=np.int64) * n >> 32, n)).astype(np.int32))

    # No null reaches the function: pandas would turn the ids into doubles.
    null_bin = F.shiftright(F.col("text_crc32") * null_bins, 32).cast("int")
    binned = counted.withColumn("_bin", F.when(F.col("doc_id").isNull(), null_bin).otherwise(bin_of(F.coalesce("doc_id", F.lit(0)), "text_crc32")))
    sizes = binned.groupBy("_bin").agg(F.sum("_n").alias("n")).toPandas()
    per_bin = np.zeros(null_bins + int(pieces.sum()), dtype=np.int64)
    per_bin[sizes["_bin"].to_numpy()] = sizes["n"].to_numpy()
    before = np.cumsum(per_bin) - per_bin

    @F.pandas_udf(T.LongType())
    def offset(b: pd.Series) -> pd.Series:
        return pd.Series(before[b.to_numpy()])

    place = Window.partitionBy("_bin").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.withColumn("_at", F.sum("_n").over(place) - F.col("_n"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return placed.select("doc_id", "text_crc32", "size", (offset("_bin") + F.col("_at")).alias("_row"), copies.alias("_copy")).select("doc_id", "text_crc32", "size", (F.col("_row") + F.col("_copy")).alias("row")), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 1729, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's shard and slot, under the law ``rows``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.crc32(body.cast("binary")).alias("text_crc32"), (F.octet_length(body) + 8).cast("long").alias("size"))
    numbered, total = number_rows(rows)
    feistel = Feistel(max(1, total), seed)

    @F.pandas_udf(T.LongType())
    def permuted(row: pd.Series) -> pd.Series:
        return pd.Series(feistel.permute(row.to_numpy()))

    return numbered.withColumn("_p", permuted("row")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
