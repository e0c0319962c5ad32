"""Projections, lookups, products, theta and band joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import graphs, joins
from larkspur.plans.registry import Tables, query


@query("pr1_projection", "SELECT p_brand AS brand, p_name AS name, p_partkey AS sku, p_size::BIGINT AS blade, p_type AS steel, p_retailprice * 1.25 AS rrp, p_retailprice AS price FROM part")
def projection(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_partkey").alias("sku"), F.col("p_size").cast("long").alias("blade"), F.col("p_type").alias("steel"), (F.col("p_retailprice") * 1.25).alias("rrp"), F.col("p_retailprice").alias("price"))


@query("pr2_nested_projection", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS title, r_name AS sub FROM nation JOIN region ON n_regionkey = r_regionkey")
def nested(t: Tables) -> DataFrame:
    tiles = t.nation.join(joins.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct(F.col("n_name").alias("title"), F.col("r_name").alias("sub")).alias("tile"))
    return tiles.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "tile.*")


@query("pr3_derived_columns", "SELECT n_nationkey::BIGINT AS n_nationkey, 'https://shop.example/knives/' || replace(lower(n_name), '_', '-') || '/#page' AS id, 'US-' || n_nationkey AS identifier FROM nation")
def derived(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.concat(F.lit("https://shop.example/knives/"), F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")), F.lit("/#page")).alias("id"), F.concat(F.lit("US-"), "n_nationkey").alias("identifier"))


@query("pr4_constant_per_outer_row", "SELECT r_name AS chip, n_name FROM region, nation")
def constant(t: Tables) -> DataFrame:
    return joins.with_each(t.region.select(F.col("r_name").alias("chip")), t.nation.select("n_name"))


@query("fl1_all_but_own", "SELECT a.n_name AS page, b.n_name AS sibling FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey")
def all_but_own(t: Tables) -> DataFrame:
    pairs = joins.with_each(t.nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("page")), t.nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("sibling")))
    return pairs.where(F.col("a") != F.col("b")).select("page", "sibling")


@query("fl2_omit_empty_block", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE '<div>' || n_name || '</div>' END AS block FROM nation")
def omit(t: Tables) -> DataFrame:
    notice = F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_name"))
    return t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.when(F.length(notice) > 0, F.concat(F.lit("<div>"), notice, F.lit("</div>"))).otherwise("").alias("block"))


@query("jn1_strict_lookup", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def strict(t: Tables) -> DataFrame:
    return joins.strict_lookup(t.nation.withColumnRenamed("n_regionkey", "key"), t.region.withColumnRenamed("r_regionkey", "key"), "key").select("n_name", "r_name")


@query("jn2_states_by_products", "SELECT n_name AS state, count(*) AS n, sum(p_partkey)::BIGINT AS key_sum FROM nation, part GROUP BY n_name")
def states_by_products(t: Tables) -> DataFrame:
    return joins.with_each(t.part.select("p_partkey"), t.nation.select(F.col("n_name").alias("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("key_sum"))


@query("jn3_states_by_brands", "SELECT n_name AS state, brand FROM nation, (SELECT DISTINCT p_brand AS brand FROM part)")
def states_by_brands(t: Tables) -> DataFrame:
    return joins.with_each(t.part.select(F.col("p_brand").alias("brand")).distinct(), t.nation.select(F.col("n_name").alias("state")))


@query("jn4_unnest", "SELECT page_id, unnest(range(1, len(l) + 1))::BIGINT AS position, unnest(l) AS element FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def unnest(t: Tables) -> DataFrame:
    return joins.unnest(t.pages.select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("l")), "l", "page_id")


@query("jn5_siblings_of_group", "SELECT a.n_name, b.n_name AS other_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def siblings(t: Tables) -> DataFrame:
    return joins.others(t.nation, "n_nationkey", ["n_regionkey"]).select("n_name", "other_n_name")


@query("jn7_links_against_declared", "SELECT doc_id, only_in FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' END AS only_in FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) WHERE only_in IS NOT NULL")
def links_against_declared(t: Tables) -> DataFrame:
    return joins.unmatched(t.documents, t.labels, "doc_id")


@query("jn7_links_by_alias", "SELECT DISTINCT 'LARGE' AS slug, 'left' AS only_in FROM part WHERE p_type = 'LARGE' UNION ALL SELECT 'optics', 'right'")
def links_by_alias(t: Tables) -> DataFrame:
    """Links name two collections by older slugs; one link leads nowhere, and one collection has no link."""
    declared = t.part.select(F.when(F.col("p_type") == "PROMO", "promotions").when(F.col("p_type") == "SMALL", "compact").otherwise(F.col("p_type")).alias("slug")).where("slug <> 'LARGE'").distinct()
    declared = declared.unionByName(t.spark.createDataFrame([("optics",)], "slug string"))
    aliases = t.spark.createDataFrame([("PROMO", "promotions"), ("SMALL", "compact")], "alias string, slug string")
    return joins.unmatched(t.part.select(F.col("p_type").alias("slug")), declared, "slug", aliases)


@query("jn10_breadcrumbs", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def breadcrumbs(t: Tables) -> DataFrame:
    chain = joins.breadcrumbs(t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "n_nationkey", "r_regionkey")
    return chain.select("s_suppkey", "n_name", "r_name")


_BRAND = "CASE WHEN p_brand <> 'Brand#7' THEN '/brand/' || p_brand END"


@query("jn11_out_of_stock_redirect", f"SELECT p_partkey AS sku, CASE WHEN p_size % 3 > 0 THEN '/product/' || p_partkey ELSE coalesce({_BRAND}, '/collections/' || p_type) END AS url FROM part")
def redirects(t: Tables) -> DataFrame:
    brand = F.when(F.col("p_brand") != "Brand#7", F.concat(F.lit("/brand/"), "p_brand"))
    return t.part.select(F.col("p_partkey").alias("sku"), joins.redirect(F.col("p_size") % 3 > 0, F.concat(F.lit("/product/"), "p_partkey"), brand, F.concat(F.lit("/collections/"), "p_type")).alias("url"))


_MOVED = "(SELECT p_partkey AS src, p_partkey + p_size - 25 AS dst FROM part WHERE p_size % 3 > 0 AND p_size <> 25)"


@query(
    "jn11_redirect_chains",
    f"WITH RECURSIVE r AS {_MOVED}, w AS (SELECT src, dst AS here, [src] AS path FROM r UNION ALL SELECT w.src, r.dst, list_append(path, w.here) FROM w JOIN r ON r.src = w.here WHERE NOT list_contains(path, w.here)), "
    "e AS (SELECT *, list_position(path, here) AS again FROM w WHERE here NOT IN (SELECT src FROM r) OR list_contains(path, here)) "
    "SELECT src, CASE WHEN again IS NULL THEN here END AS target, CASE WHEN again IS NULL THEN len(path) END AS steps, CASE WHEN again IS NOT NULL THEN list_min(list_slice(path, again, len(path))) END AS loop FROM e",
)
def redirect_chains(t: Tables) -> DataFrame:
    """Products that moved to the page of another, which may have moved as well: where each old address leads in the end."""
    moved = t.part.where((F.col("p_size") % 3 > 0) & (F.col("p_size") != 25)).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") - 25).alias("dst"))
    return graphs.redirect_chains(moved)


@query("fl27_in_stock", "SELECT p_partkey AS sku FROM part WHERE p_size % 3 > 0")
def in_stock(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size") % 3 > 0).select(F.col("p_partkey").alias("sku"))


@query(
    "jn12_related_by_brand",
    "SELECT p_partkey, related_p_partkey, rank FROM (SELECT a.p_partkey, b.p_partkey AS related_p_partkey, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_retailprice DESC, b.p_partkey) AS rank FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) WHERE rank <= 4",
)
def related(t: Tables) -> DataFrame:
    return joins.related(t.part, "p_partkey", "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")])


@query(
    "jn13_similar_products",
    "SELECT p_partkey, similar_p_partkey, rank FROM (SELECT a.p_partkey, b.p_partkey AS similar_p_partkey, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_retailprice - b.p_retailprice), abs(a.p_size - b.p_size), b.p_partkey) AS rank "
    "FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 0.25 AND abs(a.p_size - b.p_size) <= 3) WHERE rank <= 4",
)
def similar(t: Tables) -> DataFrame:
    return joins.similar(t.part, "p_partkey", "p_size", "p_retailprice", 3, 0.25)


@query(
    "jn14_bundles",
    "SELECT b.bundle_id, count(*) AS n_items, sum(p_retailprice) AS total, 0.9 * min(first_price) * 3 AS bundle_price, sum(p_retailprice) - 0.9 * min(first_price) * 3 AS saving "
    "FROM (SELECT a.p_partkey AS bundle_id, a.p_retailprice AS first_price, unnest([a.p_partkey, a.p_partkey + 1, a.p_partkey + 2]) AS k FROM part a) b JOIN part p ON b.k = p.p_partkey GROUP BY b.bundle_id",
)
def bundles(t: Tables) -> DataFrame:
    return every_bundle(t, 3)


def every_bundle(t: Tables, size: int) -> DataFrame:
    """A bundle for every product: it and the next by key, ``size`` in all, at the price of three less 10 %."""
    items = t.part.select(F.col("p_partkey").alias("bundle_id"), (0.9 * F.col("p_retailprice") * 3).alias("bundle_price"), F.explode(F.array(*[F.col("p_partkey") + k for k in range(size)])).alias("sku"))
    return joins.bundles(t.part.select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").alias("price")), items, "sku")


@query("jn15_copy_by_steel", "SELECT p_partkey AS sku, 'about ' || lower(p_type) AS copy FROM part")
def copy_by_steel(t: Tables) -> DataFrame:
    copies = t.part.select("p_type").distinct().withColumn("copy", F.concat(F.lit("about "), F.lower("p_type")))
    return t.part.join(joins.small(copies), "p_type").select(F.col("p_partkey").alias("sku"), "copy")


@query(
    "jn16_two_clicks",
    "WITH e AS (SELECT DISTINCT user_id AS src, (props->>'$.k')::BIGINT AS dst FROM events WHERE event_type = 'click'), "
    "h1 AS (SELECT DISTINCT dst AS node FROM e WHERE src < 3), h2 AS (SELECT DISTINCT e.dst AS node FROM e JOIN h1 ON e.src = h1.node), "
    "a AS (SELECT DISTINCT user_id AS node, 0 AS hops FROM events WHERE user_id < 3 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, min(hops)::BIGINT AS hops FROM a GROUP BY node",
)
def two_clicks(t: Tables) -> DataFrame:
    edges = t.events.where("event_type = 'click'").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"))
    return joins.reachable(edges, t.events.where("user_id < 3").select(F.col("user_id").alias("node")))


_HREF = "(SELECT DISTINCT page_id::VARCHAR AS page, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS hub FROM pages)"


@query(
    "jn16_click_depth",
    f"WITH RECURSIVE l AS {_HREF}, e AS (SELECT page AS src, hub AS dst FROM l UNION SELECT hub, page FROM l), "
    "d(node, depth) AS (SELECT (SELECT min(page_id) FROM pages)::VARCHAR, 0::BIGINT UNION SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE d.depth < 12) "
    "SELECT page_id::VARCHAR AS node, min(depth) AS depth, min(depth) IS NULL AS orphan FROM pages LEFT JOIN d ON page_id::VARCHAR = node GROUP BY 1",
)
def click_depth(t: Tables) -> DataFrame:
    """From the first page to all others: pages link up to their hubs, hubs down to the pages that name them."""
    named = t.pages.select(F.col("page_id").cast("string").alias("page"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("hub")).distinct()
    links = named.select(F.col("page").alias("src"), F.col("hub").alias("dst")).unionByName(named.select(F.col("hub").alias("src"), F.col("page").alias("dst")))
    home = t.pages.agg(F.min("page_id").cast("string").alias("node"))
    return graphs.click_depth(links, t.pages.select(F.col("page_id").cast("string").alias("node")), home)


@query("m18_link_graph", "SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages")
def link_graph(t: Tables) -> DataFrame:
    return t.pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()


@query("so1_bag_concatenation", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def concatenation(t: Tables) -> DataFrame:
    regions = t.region.select(F.col("r_name").alias("name"))
    return t.nation.select(F.col("n_name").alias("name")).unionByName(regions).unionByName(regions)


@query("so2_difference_both_ways", "(SELECT doc_id, 'left' AS side FROM documents EXCEPT SELECT doc_id, 'left' FROM labels) UNION ALL (SELECT doc_id, 'right' FROM labels EXCEPT SELECT doc_id, 'right' FROM documents)")
def difference(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


@query("so3_sitemap_union", "SELECT '/product/' || p_partkey AS url FROM part UNION SELECT '/collections/' || p_type FROM part UNION SELECT '/brand/' || p_brand FROM part")
def sitemap_union(t: Tables) -> DataFrame:
    kinds = F.array(F.concat(F.lit("/product/"), "p_partkey"), F.concat(F.lit("/collections/"), "p_type"), F.concat(F.lit("/brand/"), "p_brand"))
    return t.part.select(F.explode(kinds).alias("url")).distinct()


@query("so4_prepend", "SELECT c_custkey, c_mktsegment || ',a,b' AS items FROM customer")
def prepend(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.array_join(F.array_prepend(F.array(F.lit("a"), F.lit("b")), F.col("c_mktsegment")), ",").alias("items"))


@query("ag7_bundles_that_cost_more", "SELECT bundle_id FROM (SELECT a.p_partkey AS bundle_id, a.p_retailprice * 0.9 * 3 AS bundle_price, unnest([a.p_partkey, a.p_partkey + 1]) AS k FROM part a) b JOIN part p ON b.k = p.p_partkey GROUP BY bundle_id, bundle_price HAVING bundle_price >= sum(p_retailprice)")
def costly_bundles(t: Tables) -> DataFrame:
    """The constraint on bundles: those that don't cost less than their items; here of two items at the price of three less 10 %."""
    return every_costly_bundle(t)


def every_costly_bundle(t: Tables) -> DataFrame:
    return every_bundle(t, 2).where(F.col("saving") <= 0).select("bundle_id")
