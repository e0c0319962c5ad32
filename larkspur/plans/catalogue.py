"""Scans, sinks, facets and collections over ``part``, which stands for the product table:
brand = p_brand, opening = p_type, blade length in inches = p_size / 10, price = p_retailprice; ECONOMY parts are no knives.
Steel, lock, handle, shape, edges and way of opening follow from the size and are unknown for some."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import lists, numbers, text
from larkspur.operators import aggregates, feeds, joins, rule_index, rules, search
from larkspur.plans.registry import Tables, query
from larkspur.sources import sinks, tables
from larkspur.sources.scratch import scratch

PRODUCT_SQL = "(SELECT p_partkey AS sku, p_name AS name, p_brand AS brand, p_type AS opening, CAST(p_size AS DECIMAL(5,2)) / 10 AS blade_length, p_size, CAST(p_retailprice AS DECIMAL(10,2)) AS price FROM part) AS products"


def products(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("opening"),
        (F.col("p_size") / 10).cast("decimal(5,2)").alias("blade_length"), "p_size", F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        (F.col("p_type") != "ECONOMY").alias(rules.KNIFE),
    )


#: Attributes by the size modulo some number; the places left out are unknown.
ATTRIBUTES = {
    "steel": (4, {0: "D2", 1: "S30V", 3: "8Cr13MoV"}),
    "lock": (5, {0: "liner", 1: "frame", 3: "lockback", 4: "lockback"}),
    "handle": (3, {0: "G10", 2: "wood"}),
    "blade_shape": (7, {0: "tanto", 2: "dagger", 3: "drop point", 4: "drop point", 5: "clip point", 6: "clip point"}),
    "edge_count": (6, {0: "double", 1: "single", 2: "single", 3: "single", 4: "double"}),
    "way": (8, {0: "automatic", 1: "OTF", 2: "manual", 3: "manual", 4: "assisted", 5: "assisted"}),
}
_ATTRIBUTE_SQL = ", ".join(f"CASE p_size % {k} {' '.join(f"WHEN {i} THEN '{v}'" for i, v in of.items())} END AS {c}" for c, (k, of) in ATTRIBUTES.items())
ATTRIBUTE_SQL = f"(SELECT p_partkey AS sku, CAST(p_retailprice AS DECIMAL(10,2)) AS price, {_ATTRIBUTE_SQL} FROM part) AS attributes"


def attributes(t: Tables) -> DataFrame:
    known = {c: F.try_element_at(F.create_map(*[F.lit(x) for i, v in of.items() for x in (i, v)]), (F.col("p_size") % k).cast("int")) for c, (k, of) in ATTRIBUTES.items()}
    return t.part.select(F.col("p_partkey").alias("sku"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"), *[v.alias(c) for c, v in known.items()])


#: Collections of the analogue catalogue: one for each shape that a rule can have.
RULES: dict[str, rules.Rule] = {
    "all": rules.All(),
    "promo": rules.parse("opening = PROMO"),
    "promo-or-large": rules.parse("opening = PROMO OR LARGE"),
    "small-medium": rules.parse("opening = SMALL/MEDIUM"),
    "small-medium-brand-7": rules.parse("opening = SMALL/MEDIUM AND brand = Brand#7"),
    "brand-3-not-heavy": rules.parse("brand = Brand#3 AND opening NOT LARGE/PROMO/STANDARD"),
    "at-most-1-2": rules.parse("blade_length <= 1.2"),
    "under-0-55": rules.parse("blade_length < 0.55"),
    "under-925": rules.Bound("price", high=Decimal(925)),
    "unknown-opening": rules.parse("opening = OTF"),
    "curated": rules.parse("Curated", "curated"),
}
RULE_SQL = {
    "all": "TRUE",
    "promo": "p_type = 'PROMO'",
    "promo-or-large": "p_type IN ('PROMO', 'LARGE')",
    "small-medium": "p_type IN ('SMALL', 'MEDIUM')",
    "small-medium-brand-7": "p_type IN ('SMALL', 'MEDIUM') AND p_brand = 'Brand#7'",
    "brand-3-not-heavy": "p_brand = 'Brand#3' AND p_type NOT IN ('LARGE', 'PROMO', 'STANDARD')",
    "at-most-1-2": "p_size <= 12",
    "under-0-55": "p_size < 5.5",
    "under-925": "p_retailprice < 925",
    "unknown-opening": "p_type = 'OTF'",
    "curated": "p_partkey % 100 = 7",
}


def curated(t: Tables) -> DataFrame:
    """A hand-kept list: every hundredth product, from the seventh."""
    return t.part.where(F.col("p_partkey") % 100 == 7).select(F.lit("curated").alias("slug"), F.col("p_partkey").alias("sku"))


def collections(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k,) for k in RULES], "slug string")


@query("jn6_collection_membership", " UNION ALL ".join(f"SELECT '{k}' AS slug, p_partkey AS sku FROM part WHERE {v}" for k, v in RULE_SQL.items()))
def membership(t: Tables) -> DataFrame:
    return rules.membership(products(t), RULES, "sku", curated(t))


@query("jn6_collection_counts", " UNION ALL ".join(f"SELECT '{k}' AS slug, count(*) AS n_products FROM part WHERE {v}" for k, v in RULE_SQL.items()))
def collection_counts(t: Tables) -> DataFrame:
    return aggregates.counts_with_zero(membership(t), collections(t)).orderBy("slug")


@query("jn8_collections_with_products", " UNION ALL ".join(f"SELECT '{k}' AS slug WHERE EXISTS (SELECT 1 FROM part WHERE {v})" for k, v in RULE_SQL.items()))
def with_products(t: Tables) -> DataFrame:
    return collections(t).join(membership(t), "slug", "left_semi")


#: A rule a brand and size, one a size, and two of other shapes: their cells, made of the products themselves.
_CELLS_SQL = (
    "(SELECT DISTINCT p_brand || '-' || p_size AS slug, p_brand AS brand, p_size AS size, 'own' AS kind FROM part UNION ALL SELECT DISTINCT 'below-' || p_size, '', p_size, 'below' FROM part "
    "UNION ALL SELECT 'knives', '', 0, 'knives' UNION ALL SELECT 'large-or-not', '', 0, 'not')"
)


@query(
    "jn6_membership_by_index",
    f"SELECT slug, p_partkey AS sku FROM part JOIN {_CELLS_SQL} c ON c.kind = 'own' AND p_brand = c.brand AND p_size <= c.size AND p_type NOT IN ('PROMO', 'LARGE') "
    f"UNION ALL SELECT slug, p_partkey FROM part JOIN {_CELLS_SQL} c ON c.kind = 'below' AND p_size < c.size AND p_type IN ('SMALL', 'MEDIUM') "
    "UNION ALL SELECT 'knives', p_partkey FROM part WHERE p_type <> 'ECONOMY' UNION ALL SELECT 'not-promo', p_partkey FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT 'short', p_partkey FROM part WHERE p_size < 20.5 UNION ALL SELECT 'curated', p_partkey FROM part WHERE p_partkey % 100 = 7",
)
def membership_by_index(t: Tables) -> DataFrame:
    """Over a thousand rules, written as a CSV of collections and read from it: the membership of every product by the index of their terms."""
    inches = (F.col("p_size") / 10).cast("decimal(5,1)").cast("string")
    own = t.part.select(F.concat_ws("-", "p_brand", "p_size").alias("slug"), F.concat(F.lit("brand = "), "p_brand", F.lit(" AND blade_length <= "), inches, F.lit(" AND opening NOT PROMO/LARGE")).alias("filter_rule")).distinct()
    below = t.part.select(F.concat(F.lit("below-"), "p_size").alias("slug"), F.concat(F.lit("blade_length < "), inches, F.lit(" AND opening = SMALL OR MEDIUM")).alias("filter_rule")).distinct()
    few = t.spark.createDataFrame([("knives", "All knives (exclude ballistic)"), ("not-promo", "opening NOT PROMO"), ("short", "blade_length < 2.05"), ("curated", "Curated")], "slug string, filter_rule string")
    path = scratch(t.spark, "collections")
    cells = own.unionByName(below).unionByName(few)
    cells.select("slug", F.col("slug").alias("title"), F.lit("own").alias("group"), "filter_rule", F.lit("none").alias("attributes_needed"), F.lit(1).alias("build_priority"), F.lit(None).cast("string").alias("notes")).write.option("header", True).csv(path)
    return rule_index.members(products(t), tables.state_collections(t.spark, path), "sku", ["brand", "opening", "blade_length", rules.KNIFE], curated(t))


@query("fl10_knives_membership", "SELECT 'knives' AS slug, p_partkey AS sku FROM part WHERE p_type <> 'ECONOMY'")
def knives_membership(t: Tables) -> DataFrame:
    return rules.membership(products(t), {"knives": rules.parse("All knives")}, "sku")


def _facet(name: str, rule: rules.Rule, where: str) -> None:
    @query(name, f"SELECT sku, price::DOUBLE AS price FROM {PRODUCT_SQL} WHERE {where}")
    def facet(t: Tables, rule: rules.Rule = rule) -> DataFrame:
        return products(t).where(rule.condition()).select("sku", F.col("price").cast("double").alias("price"))


_facet("fl3_equality", rules.parse("opening = PROMO"), "opening = 'PROMO'")
_facet("fl4_disjunction", rules.parse("opening = PROMO OR LARGE"), "opening IN ('PROMO', 'LARGE')")
_facet("fl5_slash_list", rules.parse("opening = SMALL/MEDIUM"), "opening IN ('SMALL', 'MEDIUM')")
_facet("fl6_conjunction", rules.parse("opening = SMALL/MEDIUM AND brand = Brand#7"), "opening IN ('SMALL', 'MEDIUM') AND brand = 'Brand#7'")
_facet("fl7_negated_set", rules.parse("brand = Brand#3 AND opening NOT LARGE/PROMO/STANDARD"), "brand = 'Brand#3' AND opening NOT IN ('LARGE', 'PROMO', 'STANDARD')")
_facet("fl8_inclusive_bound", rules.parse("blade_length <= 1.2"), "blade_length <= 1.2")
_facet("fl9_exclusive_bound", rules.parse("blade_length < 0.5"), "blade_length < 0.5")
_facet("fl10_true_filter", rules.parse("All knives"), "opening <> 'ECONOMY'")
_facet("fl11_all_but_unknown_attribute", rules.parse("All knives (exclude ballistic)"), "opening <> 'ECONOMY'")
_facet("fl13_brand", rules.In("brand", ("Brand#7",)), "brand = 'Brand#7'")
_facet("fl15_price_under", rules.Bound("price", high=Decimal(950)), "price < 950")
_facet("fl17_length_between", rules.Bound("blade_length", low=Decimal(3), high=Decimal(4), high_included=True), "blade_length BETWEEN 3 AND 4")
_facet("fl17_length_over", rules.Bound("blade_length", low=Decimal(4), low_included=False), "blade_length > 4")
_facet("fl21_opening_and_origin", rules.All((rules.In("opening", ("SMALL",)), rules.In("brand", ("Brand#1", "Brand#2")))), "opening = 'SMALL' AND brand IN ('Brand#1', 'Brand#2')")
_facet("fl_any_of_rules", rules.Any((rules.parse("blade_length < 0.3"), rules.In("brand", ("Brand#9",)))), "blade_length < 0.3 OR brand = 'Brand#9'")


def _attribute_facet(name: str, rule: rules.Rule, where: str) -> None:
    @query(name, f"SELECT sku, price::DOUBLE AS price FROM {ATTRIBUTE_SQL} WHERE {where}")
    def facet(t: Tables, rule: rules.Rule = rule) -> DataFrame:
        return attributes(t).where(rule.condition()).select("sku", F.col("price").cast("double").alias("price"))


_attribute_facet("fl14_facet_value", rules.parse("steel = D2/S30V"), "steel IN ('D2', 'S30V')")
_attribute_facet("fl18_lock", rules.parse("lock = liner"), "lock = 'liner'")
_attribute_facet("fl19_handle", rules.parse("handle NOT wood"), "handle <> 'wood'")
_attribute_facet("fl20_shape", rules.parse("edge_count = single AND blade_shape NOT dagger/stiletto/dirk"), "edge_count = 'single' AND blade_shape NOT IN ('dagger', 'stiletto', 'dirk')")


@query("fl12_curated_membership", "SELECT p_partkey AS sku FROM part WHERE p_partkey % 100 = 7")
def curated_members(t: Tables) -> DataFrame:
    return products(t).join(curated(t).select("sku"), "sku", "left_semi").select("sku")


@query("fl16_price_bands", "SELECT CASE WHEN p_retailprice < 925 THEN 0 WHEN p_retailprice < 950 THEN 1 WHEN p_retailprice < 975 THEN 2 ELSE 3 END::BIGINT AS band, count(*) AS n FROM part GROUP BY 1")
def price_bands(t: Tables) -> DataFrame:
    return t.part.groupBy(numbers.price_band(F.col("p_retailprice"), [925, 950, 975]).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("fl15_cumulative_facets", "SELECT count(*) FILTER (WHERE p_retailprice < 925) AS under_925, count(*) FILTER (WHERE p_retailprice < 950) AS under_950, count(*) FILTER (WHERE p_retailprice < 975) AS under_975 FROM part")
def cumulative(t: Tables) -> DataFrame:
    return t.part.agg(*[F.count_if(F.col("p_retailprice") < p).alias(f"under_{p}") for p in (925, 950, 975)])


@query("jn9_compliance_violations", "SELECT n_name AS state, p_partkey AS sku FROM nation, part WHERE n_nationkey < 3 AND p_partkey % 7 = n_nationkey AND p_type = 'PROMO' ")
def compliance(t: Tables) -> DataFrame:
    """Products linked from a state that doesn't ship them. Links: a product to the state of its key modulo 7."""
    linked = t.part.join(joins.small(t.nation.where("n_nationkey < 7")), F.col("p_partkey") % 7 == F.col("n_nationkey"))
    banned = rules.All((rules.In("p_type", ("PROMO",)), rules.Bound("n_nationkey", high=Decimal(3))))
    return linked.where(banned.condition()).select(F.col("n_name").alias("state"), F.col("p_partkey").alias("sku"))


STATES = {0: "CA", 1: "NY", 2: "IL", 3: "MI", 4: "TX", 5: "OH"}


@query(
    "jn9_banned_products",
    f"SELECT state, sku FROM (SELECT sku, way AS opening, edge_count, blade_shape, CASE sku % 7 {' '.join(f"WHEN {k} THEN '{s}'" for k, s in STATES.items())} END AS state FROM {ATTRIBUTE_SQL}) "
    "WHERE (state IN ('CA', 'NY', 'IL') AND opening IN ('automatic', 'OTF')) OR (state = 'MI' AND (edge_count = 'double' OR blade_shape IN ('dagger', 'stiletto', 'dirk')))",
)
def banned(t: Tables) -> DataFrame:
    """Products shown by a state that bans them, by the written bans; each product is shown by one state at most."""
    state = F.try_element_at(F.create_map(*[F.lit(x) for k, s in STATES.items() for x in (k, s)]), (F.col("sku") % 7).cast("int"))
    return rules.violations(attributes(t).withColumnRenamed("way", "opening").withColumn("state", state)).select("state", "sku")


@query("fl23_indexable_only", "SELECT p_brand AS slug FROM part GROUP BY p_brand HAVING count(*) > 75")
def indexable(t: Tables) -> DataFrame:
    hubs = t.part.groupBy(F.col("p_brand").alias("slug")).agg((F.count(F.lit(1)) > 75).alias("indexable"))
    return hubs.where("indexable").select("slug")


# -- sources and sinks ----------------------------------------------------------------------------------------


@query("sc1_literal_table", "SELECT * FROM (VALUES (1::BIGINT, 'Alpha', 'alpha'), (2, 'Beta', 'beta'), (3, 'Gamma', 'gamma')) AS b(ord, name, slug)")
def literal(t: Tables) -> DataFrame:
    return tables.literal(t.spark, "brands", [(1, "Alpha", "alpha"), (2, "Beta", "beta"), (3, "Gamma", "gamma")]).withColumn("ord", F.col("ord").cast("long"))


@query("sc2_csv_scan", "SELECT p_brand AS slug, p_name || ', ' || p_type AS title, CASE WHEN p_size > 25 THEN 'opening' END AS attributes_needed, p_size::BIGINT AS build_priority FROM part")
def csv_scan(t: Tables) -> DataFrame:
    return written_collections(t).select("slug", "title", "attributes_needed", F.col("build_priority").cast("long").alias("build_priority"))


def written_collections(t: Tables) -> DataFrame:
    """Every product written and scanned as a collection, its key in ``notes``."""
    path = scratch(t.spark, "state_collections")
    own = t.part.select(
        F.col("p_brand").alias("slug"), F.concat("p_name", F.lit(", "), "p_type").alias("title"), F.lit("core").alias("group"), F.lit("Curated").alias("filter_rule"),
        F.when(F.col("p_size") > 25, "opening").otherwise("none").alias("attributes_needed"), F.col("p_size").alias("build_priority"), F.col("p_partkey").cast("string").alias("notes"),
    )
    own.write.options(header=True, emptyValue="").csv(path)
    return tables.state_collections(t.spark, path)


@query("sc3_csv_flags", "SELECT p_partkey::VARCHAR AS slug, p_size > 10 AS indexable FROM part")
def csv_flags(t: Tables) -> DataFrame:
    return written_flags(t)


def written_flags(t: Tables) -> DataFrame:
    """The flag of every product, written and scanned."""
    path = scratch(t.spark, "product_collections")
    t.part.select(
        F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("title"), F.lit("brand_hub").alias("group"), F.lit("/brand/").alias("url_pattern"),
        F.lit("BRAND field").alias("driven_by"), F.when(F.col("p_size") > 10, "YES").otherwise("NO").alias("indexable"), F.lit(1).alias("priority"), F.lit("").alias("notes"),
    ).write.option("header", True).csv(path)
    return tables.product_collections(t.spark, path).select("slug", "indexable")


@query("sc4_parse_list", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n FROM events")
def parse_list(t: Tables) -> DataFrame:
    stored = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit('[{"url":"/p/'), F.get_json_object("props", "$.k"), F.lit('"}]')))
    return t.events.select("event_id", F.size(lists.parse_list(stored)).cast("long").alias("n"))


@query("sc5_parse_scalar", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'x1' ELSE props->>'$.k' END AS BIGINT), 0) AS k FROM events")
def parse_scalar(t: Tables) -> DataFrame:
    stored = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "x1").otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", numbers.parse_number(stored, 0, "bigint").alias("k"))


@query("sc6_attribute_default", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 2 = 0 THEN props->>'$.k' END AS DOUBLE), 75.0) AS threshold FROM events")
def attribute_default(t: Tables) -> DataFrame:
    return t.events.select("event_id", numbers.parse_number(F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")), 75.0).alias("threshold"))


@query("sc7_search_export", "SELECT p_partkey::VARCHAR AS url, p_retailprice / 50 AS position, (p_size * 10)::BIGINT AS impressions, p_size::BIGINT AS clicks FROM part")
def search_export(t: Tables) -> DataFrame:
    return written_search(t)


def written_search(t: Tables) -> DataFrame:
    """Figures of every product's page, written and scanned."""
    path = scratch(t.spark, "search")
    t.part.select(F.col("p_partkey").alias("url"), (F.col("p_retailprice") / 50).alias("position"), (F.col("p_size") * 10).alias("impressions"), F.col("p_size").alias("clicks")).write.option("header", True).csv(path)
    return tables.search_performance(t.spark, path)


@query("sc8_feed_validation", "SELECT p_partkey::VARCHAR AS sku, 'opening' AS attribute, p_type AS value FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey::VARCHAR, 'price', '0.00' FROM part WHERE p_size = 1")
def feed(t: Tables) -> DataFrame:
    own = t.part.select(
        F.col("p_partkey").cast("string").alias("sku"), F.when(F.col("p_type") == "PROMO", F.col("p_type")).otherwise("manual").alias("opening"), F.lit("folding").alias("blade_type"), F.lit(None).cast("string").alias("edge_count"),
        F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_retailprice")).cast("decimal(10,2)").alias("price"),
    )
    return tables.validate_feed(own)


def _feeds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A feed and the next one: some products came, some went, prices and ways of opening changed, some of them wrongly."""
    one = F.col("p_partkey").cast("string").alias("sku")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    fixed = [F.lit("folding").alias("blade_type"), F.lit(None).cast("string").alias("edge_count")]
    before = t.part.where("p_size % 10 > 0").select(one, F.lit("manual").alias("opening"), *fixed, price.alias("price"))
    opening = F.when(F.col("p_type") == "PROMO", "OTF").when(F.col("p_type") == "LARGE", "pedal").otherwise("manual")
    after = t.part.where("p_size % 10 <> 9").select(one, opening.alias("opening"), *fixed, F.when(F.col("p_size") == 1, 0).when(F.col("p_size") == 2, price + 1).otherwise(price).cast("decimal(10,2)").alias("price"))
    return before, after


_CHANGED = "(p_type IN ('PROMO', 'LARGE') OR p_size IN (1, 2))"


@query(
    "sc8_feed_changes",
    f"SELECT p_partkey::VARCHAR AS sku, CASE WHEN p_size % 10 = 0 THEN 'inserted' WHEN p_size % 10 = 9 THEN 'removed' ELSE 'changed' END AS change, p_size % 10 <> 9 AND (p_type = 'LARGE' OR p_size = 1) AS rejected FROM part WHERE p_size % 10 IN (0, 9) OR {_CHANGED}",
)
def feed_changes(t: Tables) -> DataFrame:
    return feeds.imported(*_feeds(t))[1]


@query(
    "sc8_catalogue_after_import",
    "SELECT p_partkey::VARCHAR AS sku, CASE WHEN p_type = 'PROMO' AND NOT bad THEN 'OTF' ELSE 'manual' END AS opening, (CASE WHEN bad OR p_size <> 2 THEN p_retailprice ELSE p_retailprice + 1 END)::DECIMAL(10, 2)::DOUBLE AS price "
    "FROM (SELECT *, p_type = 'LARGE' OR p_size = 1 AS bad FROM part) WHERE p_size % 10 BETWEEN 1 AND 8 OR (p_size % 10 = 0 AND NOT bad)",
)
def catalogue_after_import(t: Tables) -> DataFrame:
    return feeds.imported(*_feeds(t))[0].select("sku", "opening", F.col("price").cast("double").alias("price"))


@query("sc8_quarantine", "SELECT p_partkey::VARCHAR AS sku, CASE WHEN p_type = 'LARGE' AND p_size = 1 THEN 'opening=pedal price=0.00' WHEN p_size = 1 THEN 'price=0.00' ELSE 'opening=pedal' END AS faults FROM part WHERE p_size % 10 <> 9 AND (p_type = 'LARGE' OR p_size = 1)")
def quarantine(t: Tables) -> DataFrame:
    return feeds.imported(*_feeds(t))[2].select("sku", F.array_join("faults", " ").alias("faults"))


@query("sk1_pages_by_key", "SELECT 'n' || n_nationkey AS slug, '<h1>' || n_name || '</h1>' AS html FROM nation")
def pages_by_key(t: Tables) -> DataFrame:
    path = scratch(t.spark, "pages")
    sinks.write_pages(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("slug"), F.concat(F.lit("<h1>"), "n_name", F.lit("</h1>")).alias("html")), path)
    return t.spark.read.text(path).select("slug", F.col("value").alias("html"))


@query(
    "sk1_changed_pages",
    "SELECT 's' || s_suppkey AS slug, CASE s_nationkey WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'removed' END AS change FROM supplier WHERE s_nationkey IN (0, 1, 9)",
)
def changed_pages(t: Tables) -> DataFrame:
    """What a second run over pages that came, changed and went writes and removes."""
    return _published_twice(t)[1]


@query("sk1_published_pages", "SELECT 's' || s_suppkey AS slug, s_name || CASE WHEN s_nationkey = 1 THEN ' in stock' ELSE '' END AS html FROM supplier WHERE s_nationkey <> 9")
def published_pages(t: Tables) -> DataFrame:
    return sinks.read_pages(t.spark, _published_twice(t)[0])


def _published_twice(t: Tables) -> tuple[str, DataFrame]:
    path, own = scratch(t.spark, "site"), F.concat(F.lit("s"), "s_suppkey").alias("slug")
    sinks.publish_pages(t.supplier.where("s_nationkey <> 0").select(own, F.col("s_name").alias("html")), path)
    html = F.concat("s_name", F.when(F.col("s_nationkey") == 1, " in stock").otherwise(""))
    return path, sinks.publish_pages(t.supplier.where("s_nationkey <> 9").select(own, html.alias("html")), path)


@query("sk2_single_page", "SELECT string_agg(r_name, ' | ' ORDER BY r_regionkey) AS html FROM region")
def single_page(t: Tables) -> DataFrame:
    path = scratch(t.spark, "page")
    sinks.write_page(aggregates.ordered_text(t.region, [], ["r_regionkey"], "r_name", " | ", "html"), path)
    return t.spark.read.text(path).select(F.col("value").alias("html"))


@query("sk3_pretty_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def pretty(t: Tables) -> DataFrame:
    doc = sinks.pretty_json(F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name")).alias("about")))
    back = F.from_json(doc, "id long, about struct<name:string>")
    return t.nation.select(F.when(F.contains(doc, F.lit("\n")), back["id"]).alias("n_nationkey"), back["about"]["name"].alias("n_name"))


@query("sk4_capped_list", "SELECT c_custkey, CASE WHEN c_custkey % 20 > 12 THEN 12 ELSE c_custkey % 20 END::BIGINT AS n FROM customer")
def capped(t: Tables) -> DataFrame:
    n = (F.col("c_custkey") % 20).cast("int")
    many = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    return t.customer.select("c_custkey", F.json_array_length(sinks.capped_json(many)).cast("long").alias("n"))


@query("sk5_sitemap", "SELECT DISTINCT 'https://shop.example/brand/' || replace(lower(p_brand), '#', '-') || '/' AS loc FROM part")
def sitemap(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sitemap")
    sinks.write_sitemap(t.part.select(F.concat(F.lit("https://shop.example/brand/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.lit("/")).alias("loc")).distinct(), path)
    return t.spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)


@query(
    "sk5_sitemap_files",
    "SELECT loc, (row_number() OVER (ORDER BY loc) - 1) // 700 AS file FROM (SELECT 'https://shop.example/product/' || p_partkey || '/?a=1&b=' || p_size AS loc FROM part UNION SELECT DISTINCT 'https://shop.example/brand/' || replace(p_brand, '#', '-') || '/' FROM part)",
)
def sitemap_files(t: Tables) -> DataFrame:
    """All products' and brands' addresses in files of 700, read by way of the index."""
    path = scratch(t.spark, "sitemaps")
    product = F.concat(F.lit("https://shop.example/product/"), "p_partkey", F.lit("/?a=1&b="), "p_size").alias("loc")
    brand = F.concat(F.lit("https://shop.example/brand/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/")).alias("loc")
    sinks.write_sitemaps(t.part.select(product).unionByName(t.part.select(brand)), path, "https://shop.example", most=700)
    return sinks.read_sitemaps(t.spark, path)


_POSTINGS_SQL = (
    "t AS (SELECT p_partkey AS sku, unnest(regexp_split_to_array(trim(lower(p_name)), '\\s+')) AS term FROM part), f AS (SELECT sku, term, count(*) AS tf FROM t GROUP BY 1, 2), "
    "v AS (SELECT term, count(*) AS df FROM f GROUP BY 1), s AS (SELECT sku, word, sum(tf * ln(1 + (SELECT count(*) FROM part) / df)) AS score FROM f JOIN v USING (term) JOIN (VALUES ('re'), ('ol')) AS w(word) ON contains(term, word) GROUP BY 1, 2)"
)


@query("sk6_search_by_index", f"WITH {_POSTINGS_SQL} SELECT sku, round(sum(score), 6) AS score, row_number() OVER (ORDER BY round(sum(score), 6) DESC, sku) AS rank FROM s GROUP BY sku HAVING count(*) = 2 ORDER BY rank LIMIT 50")
def search_by_index(t: Tables) -> DataFrame:
    """The first fifty hits for two parts of words, by an index of all products' names."""
    path = scratch(t.spark, "index")
    search.build(t.part, path, "p_partkey", "p_name")
    return search.top(t.spark, path, "ol RE", 50).withColumnRenamed("key", "sku")


@query("sk6_site_search", "SELECT p_partkey AS sku FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'bolt')")
def scanned(t: Tables) -> DataFrame:
    return t.part.where(text.site_search(F.col("p_name"), "Bolt red")).select(F.col("p_partkey").alias("sku"))
