"""All pairs of a group that link, up to what its components need: blocks first, then only what they left apart.

A group (of candidates) may hold any number of nodes, so none is gathered in one task. A group is cut into blocks of bounded
size; every block holds the group's leader too. A task compares the nodes of its block, breadth first, and emits a
spanning forest. Where the blocks of a group still fall into several clusters, the nodes outside the group's largest
cluster (mostly few) meet all blocks of the group, a task for each block and each part of bounded size of those nodes. Two
nodes are in one cluster after that exactly if links within the group join them, and a group of near copies costs
about as many comparisons as it has nodes, not their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import components, skew_join
from larkspur.llm.workspace import Stash

#: From payloads to the comparison that :func:`forest` takes.
Near = Callable[[list[bytes]], Callable[[int, np.ndarray], np.ndarray]]


def forest(near: Callable[[int, np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among n things; things linked already aren't compared again.

    ``near(x, others)`` gives those of ``others`` that link with x."""
    left, out, queue = np.arange(n), [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        found = near(x, left) if len(left) else left
        if len(found):
            out += [(x, int(y)) for y in found]
            queue += found.tolist()
            left = np.setdiff1d(left, found, assume_unique=True)
    return out


def across(near: Callable[[int, np.ndarray], np.ndarray], cluster: np.ndarray, apart: np.ndarray) -> list[tuple[int, int]]:
    """Links between the things ``apart`` and all others, one for each two clusters that meet."""
    out, name = [], cluster.copy()
    for x in apart.tolist():
        found = near(x, np.flatnonzero(name != name[x]))
        for c in np.unique(name[found]).tolist():
            y = int(found[name[found] == c][0])
            out.append((x, y))
        name[np.isin(name, name[found])] = name[x]
    return out


def _tasks(rows: DataFrame, near: Near, keys: list[str]) -> DataFrame:
    """Links (a, b) from rows (keys, node, cluster, apart, payload) sorted by task; a cluster of null: compare all."""

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        own = {r[0]: r for r in rows if not r[2]} | {r[0]: r for r in rows if r[2]}
        if len(own) < 2:
            return []
        ids = sorted(own)
        compare = near([own[x][3] for x in ids])
        if own[ids[0]][1] is None:
            found = forest(compare, len(ids))
        else:
            found = across(compare, np.array([own[x][1] for x in ids]), np.array([i for i, x in enumerate(ids) if own[x][2]], dtype=np.int64))
        return [(ids[x], ids[y]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, k = None, [], len(keys)
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 256):  # few payloads as Python objects at a time
                for r in zip(*[c.to_pylist() for c in batch.slice(a, 256).columns], strict=True):
                    if r[:k] != now:
                        found += close(rows)
                        now, rows = r[:k], []
                    rows.append(r[k:])
            if found:
                yield _links(found)
        if found := close(rows):
            yield _links(found)

    rows = rows.select(*keys, "node", "cluster", "apart", "payload")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


def link_groups(members: DataFrame, load: Callable[[DataFrame], DataFrame], near: Near, limit: int) -> DataFrame:
    """Links (a, b) that connect, within each group, what any chain of links within it connects.

    ``members``: stored rows (g, node, size); ``load`` adds to rows with ``node`` the column ``payload`` (and may copy or
    reorder rows); ``near(payloads)`` gives the comparison for :func:`forest`; ``limit``: the total size of a block."""
    stash = Stash(members.sparkSession)
    sizes = members.groupBy("g").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("c"), F.min("node").alias("leader")).where(F.col("c") > 1)
    sizes = sizes.select("g", "leader", F.ceil(F.col("total") / limit).cast("int").alias("blocks"))
    placed, placed_path = stash.save(skew_join(members, sizes, ["g"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    everywhere = F.when((F.col("node") == F.col("leader")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = load(placed).select("g", F.explode(everywhere).alias("j"), "node", F.lit(None).cast("long").alias("cluster"), F.lit(False).alias("apart"), "payload")
    links, _ = stash.save(_tasks(first, near, ["g", "j"]), "links")
    many = placed.where(F.col("blocks") > 1)
    if many.isEmpty():
        stash.drop(placed_path)
        return links
    roots = components(links)
    named = many.join(roots, "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("root")
    main = named.groupBy("g", "cluster").agg(F.sum("size").alias("s")).groupBy("g").agg(F.max_by("cluster", F.struct("s", "cluster")).alias("main"))
    named, named_path = stash.save(skew_join(named, main, ["g"]).withColumn("apart", F.col("cluster") != F.col("main")), "named")
    parts = named.where("apart").groupBy("g").agg(F.ceil(F.sum("size") / limit).cast("int").alias("parts"))
    left, left_path = stash.save(skew_join(named, parts, ["g"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")), "left")
    loaded = load(left)
    base = loaded.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "i", F.col("block").alias("j"), "node", "cluster", F.lit(False).alias("apart"), "payload")
    apart = loaded.where("apart").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", F.col("part").alias("i"), "j", "node", "cluster", F.lit(True).alias("apart"), "payload")
    more, _ = stash.save(_tasks(base.unionByName(apart), near, ["g", "i", "j"]), "links")
    for path in (placed_path, named_path, left_path):
        stash.drop(path)
    return links.unionByName(more)
