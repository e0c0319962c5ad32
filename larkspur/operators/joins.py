"""Joins of the catalogue: strict lookups, products, theta and band joins, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.dates import in_season
from larkspur.operators.ranking import gapless

#: Rows up to which a table counts as a small dimension.
SMALL_ROWS = 10_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a table, after a look that it has ``most`` rows at most; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def strict_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN1: every key of ``left`` must be in ``right``; a missing one fails the query."""
    found = right.withColumn("_found", F.lit(True))
    joined = left.join(small(found), key, "left")
    checked = F.when(F.col("_found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"no {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn(key, checked).drop("_found")


def with_each(left: DataFrame, dimension: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """JN2, JN3: every row with every row of a dimension. A larger one is cut into pieces of ``most`` rows, each broadcast in its turn."""
    if dimension.limit(most + 1).count() <= most:
        return left.crossJoin(F.broadcast(dimension))
    numbered = gapless(dimension.withColumn("_h", F.xxhash64(*dimension.columns)), ["_h"], "_i")
    pieces = -(-numbered.count() // most)
    return reduce(DataFrame.union, [left.crossJoin(F.broadcast(numbered.where(F.expr(f"_i div {most}") == i).drop("_h", "_i"))) for i in range(pieces)])


def others(rows: DataFrame, key: str, group: list[str], prefix: str = "other_") -> DataFrame:
    """JN5: every row with all other rows of its group (siblings). Equal groups meet by an equi-join."""
    right = rows.select(*[F.col(c).alias(c if c in group else f"{prefix}{c}") for c in rows.columns])
    return rows.join(right, group).where(F.col(key) != F.col(f"{prefix}{key}"))


def unnest(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """JN4: elements with their positions from 1; rows with an empty list have none."""
    return rows.select(*keep, F.posexplode(column).alias("_p", "_e")).select(*keep, (F.col("_p") + 1).cast("long").alias("position"), F.col("_e").alias("element"))


def unalias(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Keys by their proper names: ``aliases`` has (alias, ``key``), an alias once; other keys stay."""
    proper = aliases.select(F.col("alias").alias(key), F.col(key).alias("_proper"))
    return rows.join(small(proper), key, "left").withColumn(key, F.coalesce("_proper", key)).drop("_proper")


def unmatched(left: DataFrame, right: DataFrame, key: str, aliases: DataFrame | None = None) -> DataFrame:
    """JN7: both directions in one pass: keys on one side only, and which; by their proper names if there are aliases."""
    if aliases is not None:
        left, right = unalias(left.select(key).distinct(), aliases, key), unalias(right.select(key).distinct(), aliases, key)
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))


def related(products: DataFrame, key: str, group: str, order: list[Column], most: int = 4) -> DataFrame:
    """JN12: for each product the first ``most`` others of its group.

    Only the first ``most`` + 1 of a group can be anyone's related products, so the join is linear in the products."""
    ranked = products.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most + 1)
    top = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(key).alias("k")))).alias("_top"))
    picked = F.slice(F.filter("_top", lambda x: x["k"] != F.col(key)), 1, most)
    return products.join(top, group).select(key, F.posexplode(picked).alias("_p", "_x")).select(key, F.col("_x.k").alias(f"related_{key}"), (F.col("_p") + 1).cast("long").alias("rank"))


def similar(products: DataFrame, key: str, length: str, price: str, length_tolerance: int, price_tolerance: float, most: int = 4) -> DataFrame:
    """JN13: the nearest ``most`` others within both tolerances (least price gap, then length gap, then key).

    Products of one length and price are one point with its first keys (cut in the map tasks), however many they are. Each
    point looks once along every length within the tolerance: points and those who look are dealt by length and price bucket (a
    point also into the two buckets beside its own), sorted once, and the next few points on either side taken; what goes on is a few keys for each look.
    Products then take their point's list. So what is exchanged is one row a product, and a few a point."""
    rows = products.select(F.col(key).alias("k"), F.col(length).alias("l"), F.col(price).alias("p")).where("k is not null and l is not null and p is not null")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("l", "p").orderBy("k"))).where(F.col("r") <= most + 1)
    points = first.groupBy("l", "p").agg(F.sort_array(F.collect_list("k")).alias("keys")).withColumn("b", F.floor(F.col("p") / price_tolerance))
    sizes = rows.select("l").distinct().withColumn("s", F.floor(F.col("l") / length_tolerance))
    beside = F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1))
    lengths = sizes.withColumn("s", beside).join(sizes.withColumnRenamed("l", "at"), "s").where(F.abs(F.col("l") - F.col("at")) <= length_tolerance).select("l", "at")
    there = points.select(F.col("l").alias("at"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "p", F.lit(0).alias("i"), F.lit(None).cast(rows.schema["l"].dataType).alias("l"), F.struct("p", "keys").alias("point"))
    looks = points.join(lengths, "l").select("at", "b", "p", F.lit(1).alias("i"), "l", F.lit(None).cast(there.schema["point"].dataType).alias("point"))
    line = "IGNORE NULLS OVER (PARTITION BY at, b ORDER BY p, i)"
    near = F.array(*[F.expr(f"{side}(point, {n}) {line}") for side in ("lag", "lead") for n in range(1, most + 2)])
    found = there.unionByName(looks).withColumn("near", near).where("i = 1").withColumn("near", F.array_compact("near"))
    gaps = F.flatten(F.transform("near", lambda x: F.transform(x["keys"], lambda k: F.struct(F.abs(F.col("p") - x["p"]).alias("gap_p"), F.abs(F.col("l") - F.col("at")).alias("gap_l"), k.alias("k")))))
    best = F.slice(F.array_sort(F.filter(gaps, lambda x: x["gap_p"] <= price_tolerance)), 1, most + 1)
    lists = found.select("l", "p", best.alias("best")).groupBy("l", "p").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, most + 1).alias("best"))
    picked = F.slice(F.filter("best", lambda x: x["k"] != F.col("k")), 1, most)
    return rows.join(lists, ["l", "p"]).select("k", F.posexplode(picked).alias("at", "x")).select(F.col("k").alias(key), F.col("x.k").alias(f"similar_{key}"), (F.col("at") + 1).cast("long").alias("rank"))


def open_seasons(rows: DataFrame, seasons: DataFrame, state: str, day: str) -> DataFrame:
    """DT9 on a table: every row with each of its state's seasons (state, zone, weapon, open, close) that is open on its day.

    A state may have any number of windows, an open end among them (no ``close``); rows outside all of them have none."""
    windows = seasons.select(F.col("state").alias(state), "zone", "weapon", F.col("open").alias("_open"), F.col("close").alias("_close"))
    return rows.join(small(windows), state).where(in_season(F.col(day), F.col("_open"), F.col("_close"))).drop("_open", "_close")


def breadcrumbs(products: DataFrame, brands: DataFrame, categories: DataFrame, brand: str, category: str) -> DataFrame:
    """JN10: product -> brand -> category, by two lookups in small dimensions."""
    return products.join(small(brands), brand, "left").join(small(categories), category, "left")


def redirect(in_stock: Column, own: Column, brand_url: Column, category_url: Column) -> Column:
    """FL27, JN11: a product out of stock leads to its brand, or else to its category."""
    return F.when(in_stock, own).otherwise(F.coalesce(brand_url, category_url))


def bundles(products: DataFrame, bundle: DataFrame, key: str) -> DataFrame:
    """JN14, AG7: items of curated bundles with their total, the bundle's price and what it saves."""
    items = bundle.join(products.select(key, "price"), key)
    return items.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("price").alias("total"), F.first("bundle_price").alias("bundle_price")).withColumn("saving", F.col("total") - F.col("bundle_price"))


def reachable(edges: DataFrame, start: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", hops: int = 2) -> DataFrame:
    """JN16: nodes within ``hops`` links of the start nodes, with the fewest links."""
    found = start.select(F.col(node)).distinct().withColumn("hops", F.lit(0).cast("long"))
    border = found
    links = edges.select(src, dst).distinct()
    for k in range(1, hops + 1):
        step = border.join(links, F.col(node) == F.col(src)).select(F.col(dst).alias(node)).distinct()
        border = step.join(found, node, "left_anti").withColumn("hops", F.lit(k).cast("long"))
        found = found.unionByName(border)
    return found
