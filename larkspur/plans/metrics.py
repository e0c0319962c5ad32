"""Aggregations: counts, listings, ratings, carts, indicators, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import aggregates, joins, ranking
from larkspur.plans.registry import Tables, query


@query("ag1_counts_with_zero", "SELECT b.brand, count(p_partkey) FILTER (WHERE p_retailprice < 902) AS n_products FROM (SELECT DISTINCT p_brand AS brand FROM part) b LEFT JOIN part ON p_brand = b.brand GROUP BY 1")
def counts(t: Tables) -> DataFrame:
    brands = t.part.select(F.col("p_brand").alias("brand"))
    return aggregates.counts_with_zero(brands.where("p_retailprice < 902"), brands.distinct(), "brand")


@query("ag2_ordered_listing", "SELECT r_name, string_agg(n_name, ' &middot; ' ORDER BY n_nationkey) AS listing FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def listing(t: Tables) -> DataFrame:
    rows = t.nation.join(joins.small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregates.ordered_text(rows, ["r_name"], ["n_nationkey"], "n_name", " &middot; ")


@query("ag3_cardinality", "SELECT r_regionkey::BIGINT AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cardinality(t: Tables) -> DataFrame:
    return t.nation.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.size(F.collect_set("n_name")).cast("long").alias("n"))


@query(
    "ag4_ag5_ratings",
    "SELECT l_partkey, count(*) AS n_reviews, round(avg(r)::DECIMAL(18,9), 1)::DOUBLE AS rating, " + ", ".join(f"(count(*) FILTER (WHERE r = {k}) * 100 / count(*)::DOUBLE) AS pct_{k}" for k in range(1, 6)) + " FROM (SELECT l_partkey, l_quantity::BIGINT % 5 + 1 AS r FROM lineitem) GROUP BY l_partkey",
)
def ratings(t: Tables) -> DataFrame:
    return aggregates.rating_summary(t.lineitem.select("l_partkey", (F.col("l_quantity").cast("long") % 5 + 1).cast("decimal(18,9)").alias("r")), "l_partkey", "r").withColumn("rating", F.col("rating").cast("double"))


@query("ag6_cart_subtotal", "SELECT l_orderkey, round(sum((l_extendedprice::DECIMAL(14,2)) * (l_quantity::DECIMAL(6,0))), 2)::DOUBLE AS subtotal FROM lineitem GROUP BY 1")
def subtotal(t: Tables) -> DataFrame:
    found = aggregates.subtotal(t.lineitem, "l_orderkey", F.col("l_extendedprice").cast("decimal(14,2)"), F.col("l_quantity").cast("decimal(6,0)"))
    return found.select("l_orderkey", F.col("subtotal").cast("double").alias("subtotal"))


@query("ag8_rollup", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup(t: Tables) -> DataFrame:
    return t.part.rollup("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("ag9_exactly_one_primary", "SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber = 1) <> 1")
def exactly_one(t: Tables) -> DataFrame:
    return aggregates.not_exactly_one(t.lineitem, "l_orderkey", F.col("l_linenumber") == 1)


_OF = "count(*) FILTER (WHERE event_type = '{}')"
_WEEK, _K = "strftime(date_trunc('week', ts), '%Y-%m-%d')", "(props->>'$.k')::BIGINT"


@query(
    "ag10_weekly_indicators",
    f"WITH e AS (SELECT *, {_WEEK} AS week, {_K} AS url FROM events), w AS (SELECT week, "
    + ", ".join(f"{_OF.format(a)} AS {b}" for a, b in (("view", "impressions"), ("click", "clicks"), ("purchase", "orders"), ("signup", "signups")))
    + ", round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS revenue, count(DISTINCT user_id) AS visitors FROM e GROUP BY 1), "
    "p AS (SELECT week, url FROM e WHERE event_type = 'view' GROUP BY 1, 2 HAVING floor(avg(value) / 4) + 1 BETWEEN 1 AND 10), "
    "c AS (SELECT week, count(*) AS clicks_1_10 FROM e JOIN p USING (week, url) WHERE event_type = 'click' GROUP BY 1), "
    "u AS (SELECT user_id, min(week) AS week FROM e WHERE event_type = 'signup' GROUP BY 1), "
    "s AS (SELECT url, min(week) FILTER (WHERE event_type = 'view') AS since, max(week) FILTER (WHERE event_type = 'error' AND value > 150) AS until FROM e GROUP BY 1) "
    "SELECT w.*, coalesce(clicks_1_10, 0) AS clicks_1_10, (SELECT count(*) FROM u WHERE u.week <= w.week) AS list_size, "
    "(SELECT count(*) FROM s WHERE since <= w.week AND (until IS NULL OR until <= since OR until > w.week)) AS submitted_urls, "
    "clicks / nullif(impressions, 0) AS ctr, orders / nullif(clicks, 0) AS cvr, revenue / nullif(orders, 0) AS aov FROM w LEFT JOIN c USING (week)",
)
def indicators(t: Tables) -> DataFrame:
    """The scorecard: a page's position in a week is the mean of its views' values in fours, a page is in the sitemaps from its first view until its last grave error."""
    events = t.events.withColumn("week", F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd")).withColumn("url", F.get_json_object("props", "$.k").cast("long"))
    kind = lambda x: F.col("event_type") == x
    found = aggregates.kpis(events, F.col("week"))
    weeks = found.select("week")
    positions = events.where(kind("view")).groupBy("week", "url").agg((F.floor(F.avg("value") / 4) + 1).alias("position"))
    front = aggregates.clicks_in_front(events.where(kind("click")), positions).withColumnRenamed("clicks_in_front", "clicks_1_10")
    subscribers = aggregates.list_size(events.where(kind("signup")), weeks, "user_id")
    spans = events.groupBy("url").agg(F.min(F.when(kind("view"), F.col("week"))).alias("since"), F.max(F.when(kind("error") & (F.col("value") > 150), F.col("week"))).alias("until"))
    spans = spans.where("since is not null").withColumn("until", F.when(F.col("until") > F.col("since"), F.col("until")))
    revenue = F.round("revenue", 2)
    scored = found.withColumns({"revenue": revenue, "aov": revenue / F.nullif(F.col("orders"), F.lit(0))}).join(front, "week", "left").join(subscribers, "week").join(aggregates.submitted(spans, weeks), "week")
    return scored.withColumn("clicks_1_10", F.coalesce("clicks_1_10", F.lit(0)))


@query("ag11_attribute_coverage", "SELECT 'quality' AS attribute, count(quality) AS filled, count(quality) / count(*)::DOUBLE AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'lang', count(lang), count(lang) / count(*)::DOUBLE FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coverage(t: Tables) -> DataFrame:
    return aggregates.coverage(t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left"), ["quality", "lang"])


@query("ag12_duplicate_copy", "SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_copy(t: Tables) -> DataFrame:
    return aggregates.duplicate_copy(t.documents, F.col("text"))


@query("ag13_sitemap_size", "SELECT count(DISTINCT p_brand) + count(DISTINCT p_type) + count(*) AS urls, count(DISTINCT p_brand) + count(DISTINCT p_type) + count(*) < 5000 AS ok FROM part")
def sitemap_size(t: Tables) -> DataFrame:
    n = F.count_distinct("p_brand") + F.count_distinct("p_type") + F.count(F.lit(1))
    return t.part.agg(n.alias("urls")).withColumn("ok", F.col("urls") < 5000)


@query("wn6_against_targets", "SELECT metric, value, target, target - value AS gap, value >= target AS met FROM (SELECT event_type AS metric, count(*)::DOUBLE AS value, CASE event_type WHEN 'click' THEN 2000.0 WHEN 'purchase' THEN 1500.0 END AS target FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type)")
def targets(t: Tables) -> DataFrame:
    goal = t.spark.createDataFrame([("click", 2000.0), ("purchase", 1500.0)], "metric string, target double")
    return ranking.against_targets(t.events.groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")), goal).select("metric", "value", "target", "gap", "met")


_SEARCH = "(SELECT l_partkey AS url, round(avg(l_quantity) * 0.75, 4) AS position, sum(l_quantity)::BIGINT AS impressions, count(*) FILTER (WHERE l_returnflag = 'R') AS clicks FROM lineitem GROUP BY 1)"


def _search(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("url")).agg(F.round(F.avg("l_quantity") * 0.75, 4).alias("position"), F.sum("l_quantity").cast("long").alias("impressions"), F.count_if(F.col("l_returnflag") == "R").alias("clicks"))


@query("fl22_worklist", f"SELECT url, impressions, clicks FROM {_SEARCH} WHERE position BETWEEN 5 AND 20 AND impressions > 50 AND clicks / impressions < 0.015")
def worklist(t: Tables) -> DataFrame:
    return ranking.worklist(_search(t)).select("url", "impressions", "clicks")


@query("or4_titles_to_rewrite", f"SELECT url, impressions FROM {_SEARCH} WHERE position BETWEEN 5 AND 20 AND impressions > 50 AND clicks / impressions < 0.015 ORDER BY impressions DESC, url LIMIT 100")
def titles(t: Tables) -> DataFrame:
    return ranking.top(worklist(t).select("url", "impressions"), [F.desc("impressions"), F.asc("url")], 100)
