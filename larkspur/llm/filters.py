"""Bloom filters of ids: what can't join needn't be shuffled.

A filter has about ten bits for each id, 2 ** ``MOST_BITS`` (128 MB) at most, so it can be broadcast for any input; when ids outgrow
it, it only lets more rows through. Tasks set bits of their own; parts of the bit field are merged as a stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BITS, MOST_BITS, PART, HASHES = 16, 30, 1 << 12, 4


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id: double hashing on a mixed id."""
    x = ids.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64((1 << bits) - 1)).astype(np.int64)


class Sieve:
    """Passes every id that it was made of, and few others; a broadcast bit field."""

    def __init__(self, shared: Broadcast, bits: int):
        self.shared, self.bits = shared, bits

    def known(self, ids: np.ndarray) -> np.ndarray:
        at = places(ids, self.bits)
        return (self.shared.value[at >> 3] >> (at & 7) & 1).all(axis=0)

    def passes(self, ids: pa.Array) -> pa.Array:
        """Nulls don't pass."""
        return pa.array(self.known(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))


def sieve(rows: DataFrame, column: str) -> Sieve:
    """The sieve of the ids among ``rows``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (10 * rows.count()).bit_length()))
    schema = "part int, field binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, found = np.zeros(1 << bits - 3, dtype=np.uint8), False
        for batch in batches:
            at = places(batch.column(0).drop_null().to_numpy(), bits).ravel()
            np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
            found = found or len(at) > 0
        if found:
            parts = field.reshape(-1, PART)
            full = np.flatnonzero(parts.any(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in full], pa.binary())], names=["part", "field"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, field in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(field), dtype=np.uint8)
                total[part] = total[part] | own if part in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "field"])

    whole = np.zeros((max(1, (1 << bits - 3) // PART), PART), dtype=np.uint8)
    for r in rows.select(F.col(column).cast("long").alias("i")).mapInArrow(mark, schema).repartition("part").mapInArrow(merge, schema).toLocalIterator():
        whole[r["part"]] = np.frombuffer(r["field"], dtype=np.uint8)
    return Sieve(rows.sparkSession.sparkContext.broadcast(whole.reshape(-1)), bits)


def build(rows: DataFrame, column: str) -> Callable[[str], Column]:
    """A condition that holds for every id among ``rows``, and for few others; nulls fail it."""
    own = sieve(rows, column)

    @F.pandas_udf(T.BooleanType())
    def known(ids: pd.Series) -> pd.Series:
        return pd.Series(own.known(ids.to_numpy(dtype=np.int64)))

    return lambda c: F.when(F.col(c).isNull(), False).otherwise(known(F.coalesce(F.col(c), F.lit(0)).cast("long")))
