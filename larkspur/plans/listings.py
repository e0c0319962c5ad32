"""Positions, tops and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import ranking
from larkspur.operators import joins
from larkspur.plans.registry import Tables, query


@query("wn1_wn2_ordinals", "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS first FROM nation")
def ordinals(t: Tables) -> DataFrame:
    return ranking.numbered(t.nation, ["n_regionkey"], [F.asc("n_nationkey")]).select("n_name", "position", "first")


@query(
    "wn4_product_lists",
    "SELECT 'new' AS list, sku, rank FROM (SELECT p_brand, p_partkey AS sku, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rank FROM part) WHERE rank <= 4 UNION ALL SELECT 'best', sku, rank FROM (SELECT p_partkey AS sku, row_number() OVER (PARTITION BY p_brand ORDER BY units DESC, p_partkey) AS rank FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS units FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) WHERE rank <= 4 "
    "UNION ALL SELECT 'sale', sku, rank FROM (SELECT p_partkey AS sku, row_number() OVER (PARTITION BY p_brand ORDER BY discount DESC, p_partkey) AS rank FROM part JOIN (SELECT l_partkey, max(l_discount) AS discount FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) WHERE rank <= 4",
)
def product_lists(t: Tables) -> DataFrame:
    """New arrivals, best sellers and on sale: four a brand. One pass over the lines serves both of the latter."""
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("units"), F.max("l_discount").alias("discount"))
    parts = t.part.select("p_partkey", "p_brand")
    both = parts.join(sold, "p_partkey")
    lists = [("new", parts, [F.desc("p_partkey")]), ("best", both, [F.desc("units"), F.asc("p_partkey")]), ("sale", both, [F.desc("discount"), F.asc("p_partkey")])]
    out = [ranking.top_per_group(rows, ["p_brand"], order, 4).select(F.lit(name).alias("list"), F.col("p_partkey").alias("sku"), "rank") for name, rows, order in lists]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("or1_declared_order", "SELECT row_number() OVER (ORDER BY r_name DESC) AS ord, r_name FROM region")
def declared(t: Tables) -> DataFrame:
    order = t.spark.createDataFrame([(i, n) for i, n in enumerate(("MIDDLE EAST", "EUROPE", "ASIA", "AMERICA", "AFRICA"), 1)], "ord long, r_name string")
    return order.join(t.region.select("r_name"), "r_name").select("ord", "r_name").orderBy("ord")


@query("or2_prefix_slice", "SELECT r_name, array_to_string((list(n_name ORDER BY n_nationkey))[1:4], ',') AS four FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def prefix(t: Tables) -> DataFrame:
    rows = t.nation.join(joins.small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return rows.groupBy("r_name").agg(F.array_join(F.slice(names, 1, 4), ",").alias("four"))


_SCORE = "CASE WHEN p_size % 3 > 0 THEN 1.0 ELSE 0.0 END * (p_retailprice - 900) * p_size"


@query("or3_top_skus", f"SELECT p_partkey AS sku, {_SCORE} AS score FROM part ORDER BY score DESC, sku LIMIT 1000")
def top_skus(t: Tables) -> DataFrame:
    from larkspur.plans.functions import sku_score

    return ranking.top(sku_score(t), [F.desc("score"), F.asc("sku")], 1000)


@query("or5_top_margins_in_stock", "SELECT p_partkey AS sku FROM part WHERE p_size % 3 > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 200")
def margins(t: Tables) -> DataFrame:
    return ranking.top(t.part.where(F.col("p_size") % 3 > 0), [F.desc("p_retailprice"), F.asc("p_partkey")], 200).select(F.col("p_partkey").alias("sku"))


@query("or6_spokes_per_hub", "SELECT p_brand, sku, rank FROM (SELECT p_brand, p_partkey AS sku, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 20")
def spokes(t: Tables) -> DataFrame:
    return ranking.top_per_group(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 20).select("p_brand", F.col("p_partkey").alias("sku"), "rank")


@query("or7_by_priority", "SELECT o_orderkey, o_orderpriority FROM orders")
def by_priority(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderpriority").orderBy("o_orderpriority", "o_orderkey")


@query("or8_photos_first", "SELECT page_id, html LIKE '%<img%' AS has_image FROM pages")
def photos(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.regexp_extract_all("html", F.lit("(<img)"), F.lit(1)).alias("images"))
    return ranking.photos_first(rows, [F.asc("page_id")]).select("page_id", (F.size("images") > 0).alias("has_image"))


@query("or9_repeat", "SELECT n_nationkey::BIGINT AS n_nationkey, unnest(range(1, n_regionkey + 1))::BIGINT AS copy FROM nation WHERE n_regionkey > 0")
def repeat(t: Tables) -> DataFrame:
    return ranking.repeated(t.nation, F.col("n_regionkey")).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("copy").cast("long").alias("copy"))
