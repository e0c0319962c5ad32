"""Connected components on tables in the shared folder: local forests first, then alternating large and small stars.

Links are first read in pieces of about ``PIECE`` and each piece is contracted to a forest of stars, in memory bounded by its
size. One piece is the answer already; of several, the forests are joined by star steps. Every step is an aggregate with map-side combination or a join whose both sides are exchanged for it, so that a
node with a great many links is spread over tasks. Each round is written out, which keeps lineage short and
survives lost executors; only a count and a checksum of the links come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.workspace import Stash

#: Links that one task contracts at once (16 bytes each).
PIECE = 500_000


def meeting(*keys: str) -> Column:
    """A join key besides ``keys`` that no aggregate is partitioned by: with it both sides of a join are exchanged
    for the join alone, and adaptive execution can split the hot partitions of one side."""
    return F.xxhash64(*[F.col(k) for k in keys])


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a side with hot keys to one with unique keys."""
    return left.withColumn("_meet", meeting(*keys)).join(right.withColumn("_meet", meeting(*keys)), ["_meet", *keys], how).drop("_meet")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return skew_join(both.where(F.col("v") > F.col("u")), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = skew_join(links, least, ["u"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that aren't the least of their component, and those least nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _forests(links: DataFrame) -> DataFrame:
    """Each partition's links contracted, in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def close() -> pa.RecordBatch:
            u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            n += batch.num_rows
            if n >= 2 * PIECE:
                yield close()
                held, n = [], 0
        if held:
            yield close()

    return links.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node that isn't its own root."""
    stash = Stash(edges.sparkSession)
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links, path = stash.save(start.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")), "links")
    pieces = -(-links.count() // PIECE)
    contracted, new = stash.save(_forests(links.coalesce(max(1, pieces))), "links")
    stash.drop(path)
    links, path, state = contracted, new, None
    while pieces > 1:
        after = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state or not after[0]:
            break
        state = after
        links, new = stash.save(_small_star(_large_star(links)), "links")
        stash.drop(path)
        path = new
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
