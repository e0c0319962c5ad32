"""Iterations over links: redirect chains by pointer doubling, click depth by frontiers. Each round is a written table, so plans stay short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.scratch import scratch, stored


def redirect_chains(redirects: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """JN11 over several steps: ``src``, its last ``target``, the number of ``steps``, and ``loop``.

    A round doubles the steps that every pointer has made: 20 rounds for chains of a million. A pointer that has left the
    table has its target and takes no part any more. As soon as a round brings no chain to its end, no chain is left
    (one that is longer holds one of each length below), only loops: of these each has the least address on it
    as its name in ``loop``, also for addresses that only lead to it; they have no target and no steps.

    An address with several redirects takes the least; rows with a null are left out; an address that redirects to itself is a loop of one."""
    kept = redirects.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("at")).agg(F.min(dst).alias("to"))
    open_ = stored(kept.select("at", "to", F.lit(1).cast("long").alias("steps")), "redirects")
    left, found = open_.count(), []
    while left:
        ahead = open_.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        # Ends found earlier are ahead of pointers too: a chain meets them by their own rows.
        ended = [f.select(F.col("at").alias("to"), F.col("target").alias("_to"), F.col("steps").alias("_steps")).withColumn("_end", F.lit(True)) for f in found]
        known = reduce(DataFrame.unionByName, ended, ahead.withColumn("_end", F.lit(False)))
        moved = open_.join(known, "to", "left")
        end = F.col("_to").isNull() | F.col("_end")
        round_ = stored(moved.select("at", F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), end.alias("end")), "redirects")
        found.append(round_.where("end").select("at", F.col("to").alias("target"), "steps"))
        open_ = round_.where("not end").select("at", "to", "steps")
        before, left = left, open_.count()
        if left == before:
            break
    out = [f.select(F.col("at").alias(src), "target", "steps", F.lit(None).cast(redirects.schema[src].dataType).alias("loop")) for f in found]
    if left:
        loops = _loops(open_.join(kept.withColumnRenamed("to", "next"), "at").select("at", F.col("next").alias("to")), left)
        out.append(loops.select(F.col("at").alias(src), F.lit(None).cast(redirects.schema[dst].dataType).alias("target"), F.lit(None).cast("long").alias("steps"), "loop"))
    return reduce(DataFrame.unionByName, out) if out else kept.select(F.col("at").alias(src), F.col("to").alias("target"), F.lit(0).cast("long").alias("steps"), F.col("at").alias("loop"))


def _loops(pointers: DataFrame, n: int) -> DataFrame:
    """``at`` and ``loop``, for addresses that all lead to loops: doubled until every pointer is on its loop and has been all round."""
    now, steps = stored(pointers.select("at", "to", F.least("at", "to").alias("least")), "loops"), 1
    while steps < n:
        ahead = now.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        now = stored(now.join(ahead, "to").select("at", F.col("_to").alias("to"), F.least("least", "_least").alias("least")), "loops")
        steps *= 2
    around = now.select(F.col("at").alias("to"), F.col("least").alias("loop"))  # from a place on the loop, all addresses passed are on it
    return now.join(around, "to").select("at", "loop")


def click_depth(links: DataFrame, pages: DataFrame, start: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """JN16 for all pages: the fewest clicks (``depth``) from the start pages to each of ``pages``, null and ``orphan`` for those that no click leads to.

    Rounds as long as there are new pages; each reads the links and the stored rounds before it. Pages not among ``pages`` are passed through."""
    spark = links.sparkSession
    edges = stored(links.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(src, dst).distinct(), "links")
    folder, schema = scratch(spark, "depths"), f"node {links.schema[src].dataType.simpleString()}"
    start.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct().write.parquet(f"{folder}/depth=0")
    depth = 0
    while not spark.read.schema(schema).parquet(f"{folder}/depth={depth}").isEmpty():
        border = spark.read.schema(schema).parquet(f"{folder}/depth={depth}")
        reached = spark.read.schema(f"{schema}, depth int").parquet(folder).select("node")
        step = border.join(edges, F.col("node") == F.col(src)).select(F.col(dst).alias("node")).distinct()
        depth += 1
        step.join(reached, "node", "left_anti").write.parquet(f"{folder}/depth={depth}")
    found = spark.read.schema(f"{schema}, depth long").parquet(folder)
    return pages.select(F.col(node).alias("node")).distinct().join(found, "node", "left").select(F.col("node").alias(node), "depth", F.col("depth").isNull().alias("orphan"))
