"""Assembly of pages: nested page data folded into text with order kept, and structured data beside it.

Templates are parameters with ``{slots}``; the defaults are plain. State-independent parts (product cards of one chip apart,
brands, tabs) are rendered once and joined to every page, not rendered again for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.lists import join
from larkspur.functions.text import template
from larkspur.operators.aggregates import ordered_text
from larkspur.operators.joins import strict_lookup, with_each


@dataclass(frozen=True)
class Site:
    """Names and templates of a site."""

    name: str = "Shop"
    url: str = "https://shop.example"
    root: str = "knives"
    card: str = '<article><b>{chip}</b><a href="/product/{slug}/">{name}</a> {brand} {blade}&Prime; {steel} <s>${rrp}</s> ${price}</article>'
    category: str = '<a href="/collections/{slug}/"><img src="/img/{img}" alt="{name}">{name}<i>{count} products</i></a>'
    brand: str = '<a href="/brand/{slug}/">{name}</a>'
    legal: str = '<dt>{label}</dt><dd class="{cls}"><b>{pill}</b>{text}</dd>'
    source: str = '<a href="{url}" rel="noopener">{title}</a>'
    sibling: str = '<li><a href="/{root}/{slug}/">{name}</a></li>'
    hub_card: str = '<a href="/{root}/{slug}/">{name} ({abbr}): {tagline}</a>'
    hub_row: str = '<tr><th>{name}</th><td>{blade}</td><td class="{auto_cls}">{auto}</td><td class="{concealed_cls}">{concealed}</td><td class="{preemption_cls}">{preemption}</td></tr>'
    tabs: tuple[str, ...] = ("New Arrivals", "Best Sellers", "On Sale")
    home: str = "Home"
    hub: str = "By Region"
    page: str = "{name}"


def _fields(x: Column, *names: str) -> dict[str, Column]:
    return {n: x[n] for n in names}


def product_cards(states: DataFrame, products: DataFrame, site: Site) -> DataFrame:
    """JN2 and AG2: (slug, cards) with a card of every product under each state's chip, in the products' order."""
    pairs = with_each(products.select(F.struct("*").alias("p")), states.select("slug", "chip"))
    card = template(site.card, chip=F.col("chip"), **_fields(F.col("p"), "slug", "name", "brand", "blade", "steel", "rrp", "price"))
    return ordered_text(pairs.select("slug", F.col("p.ord").alias("ord"), card.alias("card")), ["slug"], ["ord"], "card", name="cards")


def brand_strip(brands: DataFrame, site: Site) -> DataFrame:
    """One row for all pages."""
    return ordered_text(brands.select("ord", template(site.brand, slug=F.col("slug"), name=F.col("name")).alias("b")), [], ["ord"], "b", name="brands")


def category_strips(states: DataFrame, counts: DataFrame | None, site: Site) -> DataFrame:
    """JN4, AG1: (slug, _cats) with the categories of each page in their order, and how many products each has (0 if not counted)."""
    cats = states.select("slug", F.posexplode("cats").alias("_o", "_x")).withColumn("_s", F.col("_x.slug"))
    sized = cats.withColumn("_n", F.lit(0).cast("long")) if counts is None else cats.join(counts.select(F.col("slug").alias("_s"), F.col("n_products").cast("long").alias("_n")), "_s", "left")
    x = F.col("_x")
    item = template(site.category, **_fields(x, "slug", "img", "name"), count=F.coalesce("_n", F.lit(0)))
    return ordered_text(sized.select("slug", "_o", item.alias("item")), ["slug"], ["_o"], "item", name="_cats")


def sibling_lists(siblings: DataFrame, site: Site) -> DataFrame:
    """JN5: (slug, siblings) with all other states in the declared order."""
    pairs = with_each(siblings.select("slug"), siblings.select(F.col("ord").alias("_o"), F.col("slug").alias("_s"), F.col("name").alias("_n"))).where(F.col("slug") != F.col("_s"))
    item = template(site.sibling, root=F.lit(site.root), slug=F.col("_s"), name=F.col("_n"))
    return ordered_text(pairs.select("slug", "_o", item.alias("item")), ["slug"], ["_o"], "item", name="siblings")


def tab_strip(site: Site) -> Column:
    """WN1, WN2: buttons numbered from 1, the first one selected, and their panels, the others hidden."""
    names = F.array(*[F.lit(n) for n in site.tabs])
    button = lambda n, i: F.concat(F.lit('<button id="t'), (i + 1).cast("string"), F.lit('" aria-selected="'), F.when(i == 0, "true").otherwise("false"), F.lit('">'), n, F.lit("</button>"))
    panel = lambda n, i: F.concat(F.lit('<section id="p'), (i + 1).cast("string"), F.when(i == 0, '">').otherwise('" hidden>'), F.lit("</section>"))
    return F.concat(F.array_join(F.transform(names, button), ""), F.array_join(F.transform(names, panel), ""))


def breadcrumb_json(site: Site, name: Column) -> Column:
    """M19: a BreadcrumbList, last item without a link."""
    item = lambda k, text, url: F.struct(F.lit("ListItem").alias("@type"), F.lit(k).alias("position"), text.alias("name"), url.alias("item"))
    items = F.array(item(1, F.lit(site.home), F.lit(f"{site.url}/")), item(2, F.lit(site.hub), F.lit(f"{site.url}/{site.root}/")), item(3, name, F.lit(None).cast("string")))
    return F.struct(F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement"))


def state_pages(states: DataFrame, products: DataFrame, brands: DataFrame, siblings: DataFrame, counts: DataFrame | None = None, site: Site = Site()) -> DataFrame:
    """L1: (slug, html, json_ld) of every state. ``counts`` (slug, n_products) fills in the categories' sizes."""
    pages = states.join(category_strips(states, counts, site), "slug", "left").join(product_cards(states, products, site), "slug", "left")
    pages = pages.join(sibling_lists(siblings, site), "slug", "left").crossJoin(brand_strip(brands, site))
    none = F.lit("")
    cats = F.coalesce("_cats", none)
    legal = join(F.col("legal"), "", lambda x: template(site.legal, **_fields(x, "label", "cls", "pill", "text")))
    sources = join(F.col("sources"), " &middot; ", lambda x: template(site.source, **_fields(x, "title", "url")))
    notice = F.when(F.length("notice") > 0, F.concat(F.lit("<aside>"), "notice", F.lit("</aside>"))).otherwise("")
    html = F.concat(
        F.lit("<h1>"), F.upper("h1"), F.lit("</h1><p>"), "hero", F.lit('</p><a href="/collections/'), F.col("tile.slug"), F.lit('/">'), F.col("tile.title"), F.lit("</a>"),
        F.coalesce("cards", none), tab_strip(site), cats, F.coalesce("brands", none), F.lit("<dl>"), legal, F.lit("</dl>"), notice, F.lit("<p>"), sources, F.lit("</p><ul>"), F.coalesce("siblings", none), F.lit("</ul>"),
    )
    page = F.struct(F.lit("CollectionPage").alias("@type"), template("{url}/{root}/{slug}/#page", url=F.lit(site.url), root=F.lit(site.root), slug=F.col("slug")).alias("@id"), template(site.page, name=F.col("name")).alias("name"))
    ld = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.to_json(page), F.lit(","), F.to_json(breadcrumb_json(site, F.col("name"))), F.lit("]}"))
    return pages.select("slug", html.alias("html"), ld.alias("json_ld"))


def hub_page(states: DataFrame, hub: DataFrame, siblings: DataFrame, site: Site = Site()) -> DataFrame:
    """L2: one row (html, json_ld), states in the siblings' order; a state or hub row that is missing fails (JN1)."""
    rows = strict_lookup(strict_lookup(siblings.select("ord", "slug"), states.select("slug", "name", "abbr"), "slug"), hub, "slug")
    card = template(site.hub_card, root=F.lit(site.root), **{c: F.col(c) for c in ("slug", "name", "abbr", "tagline")})
    row = template(site.hub_row, name=F.col("name"), blade=F.col("blade"), **{k: v for c in ("auto", "concealed", "preemption") for k, v in ((f"{c}_cls", F.col(c)["cls"]), (c, F.col(c)["text"]))})
    items = F.array_sort(F.collect_list(F.struct("ord", card.alias("card"), row.alias("row"), F.col("name").alias("name"), F.col("slug").alias("slug"))))
    one = rows.agg(items.alias("x"))
    listed = F.transform("x", lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), template(site.page, name=x["name"]).alias("name"), F.concat(F.lit(f"{site.url}/{site.root}/"), x["slug"], F.lit("/")).alias("url")))
    ld = F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.size("x").alias("numberOfItems"), listed.alias("itemListElement")))
    return one.select(F.concat(F.lit("<nav>"), join(F.col("x"), "", lambda x: x["card"]), F.lit("</nav><table>"), join(F.col("x"), "", lambda x: x["row"]), F.lit("</table>")).alias("html"), ld.alias("json_ld"))
