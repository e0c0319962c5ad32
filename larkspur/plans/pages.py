"""Page assembly over ``nation`` and ``region`` in the place of states, with products from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import assemble, ranking
from larkspur.plans.registry import Tables, query


def _slug(c: str) -> F.Column:
    return F.replace(F.lower(c), F.lit("_"), F.lit("-"))


def states(t: Tables) -> DataFrame:
    row = lambda label, cls: F.struct(F.lit(label).alias("label"), F.lit(cls).alias("cls"), F.lit(cls).alias("pill"), F.col("n_name").alias("text"))
    return t.nation.select(
        F.col("n_nationkey").alias("ord"), _slug("n_name").alias("slug"), F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("abbr"), F.concat(F.lit("Knives in "), "n_name").alias("h1"), F.lit("Hero").alias("hero"),
        F.struct(F.lit("Tile").alias("title"), F.lit("Sub").alias("sub"), F.lit("tile").alias("slug")).alias("tile"), F.concat(F.lit("Legal in "), "n_name").alias("chip"),
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n.lower()).alias("slug"), F.lit(f"{n.lower()}.jpg").alias("img")) for n in ("PROMO", "LARGE")]).alias("cats"),
        F.array(row("Blade", "ok"), row("Carry", "warn")).alias("legal"), F.when(F.col("n_regionkey") == 0, "Note").otherwise("").alias("notice"),
        F.array(F.struct(F.lit("Code").alias("title"), F.lit("https://law.example/").alias("url"))).alias("sources"),
    )


def _products(t: Tables) -> DataFrame:
    """The product strip: the six dearest products, as many as a page has."""
    return ranking.top(t.part, [F.desc("p_retailprice"), F.asc("p_partkey")], 6).select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("p-"), "p_partkey").alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.col("p_size") / 10).cast("decimal(5,2)").alias("blade"),
        F.col("p_type").alias("steel"), (F.col("p_retailprice") * 1.25).cast("decimal(10,2)").alias("rrp"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
    )


@query(
    "l1_state_pages",
    "SELECT replace(lower(a.n_name), '_', '-') AS slug, upper('Knives in ' || a.n_name) AS head, (SELECT least(6, count(*)) FROM part) AS n_cards, 24::BIGINT AS n_siblings, a.n_regionkey = 0 AS has_notice, "
    "(SELECT string_agg(replace(lower(b.n_name), '_', '-'), ',' ORDER BY b.n_nationkey) FROM nation b WHERE b.n_nationkey <> a.n_nationkey) AS siblings, (SELECT count(*) FROM part WHERE p_type = 'PROMO') AS n_promo FROM nation a",
)
def state_pages(t: Tables) -> DataFrame:
    siblings = t.nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), _slug("n_name").alias("slug"))
    brands = t.region.select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"))
    counts = t.part.groupBy(F.lower("p_type").alias("slug")).agg(F.count(F.lit(1)).alias("n_products"))
    html = F.col("html")
    found = F.regexp_extract_all(html, F.lit('<li><a href="/knives/([^/]*)/">'), F.lit(1))
    return assemble.state_pages(states(t), _products(t), brands, siblings, counts).select(
        "slug", F.regexp_extract(html, "<h1>([^<]*)</h1>", 1).alias("head"), F.size(F.regexp_extract_all(html, F.lit("(<article>)"), F.lit(1))).cast("long").alias("n_cards"),
        F.size(found).cast("long").alias("n_siblings"), F.contains(html, F.lit("<aside>")).alias("has_notice"), F.array_join(found, ",").alias("siblings"),
        F.regexp_extract(html, "PROMO<i>([0-9]+) products", 1).cast("long").alias("n_promo"),
    )


@query("l2_hub_page", "SELECT count(*) AS n_rows, string_agg(replace(lower(n_name), '_', '-'), ',' ORDER BY n_nationkey DESC) AS slugs, '{\"@type\":\"ItemList\",\"numberOfItems\":' || count(*) || ',' AS head FROM nation")
def hub(t: Tables) -> DataFrame:
    siblings = t.nation.select((100 - F.col("n_nationkey")).alias("ord"), F.col("n_name").alias("name"), _slug("n_name").alias("slug"))
    pair = lambda cls, text: F.struct(F.lit(cls).alias("cls"), F.lit(text).alias("text"))
    rows = t.nation.select(_slug("n_name").alias("slug"), F.lit("tag").alias("tagline"), F.lit("any").alias("blade"), pair("yes", "legal").alias("auto"), pair("part", "limits").alias("concealed"), pair("no", "none").alias("preemption"))
    page = assemble.hub_page(states(t), rows, siblings)
    return page.select(
        F.size(F.regexp_extract_all("html", F.lit("(<tr>)"), F.lit(1))).cast("long").alias("n_rows"), F.array_join(F.regexp_extract_all("html", F.lit('<a href="/knives/([^/]*)/">'), F.lit(1)), ",").alias("slugs"),
        F.regexp_extract("json_ld", r'^(\{"@type":"ItemList","numberOfItems":\d+,)', 1).alias("head"),
    )
