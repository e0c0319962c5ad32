"""Bans, aliases, seasons, the worklist, similar products, timers and pages at sizes beyond a small dimension."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larkspur.operators import assemble, joins, ranking, rules
from larkspur.plans import pages, registry
from larkspur.plans.registry import Tables
from larkspur.streaming import runs, visitors


def test_bans(spark):
    shown = spark.createDataFrame(
        [("CA", "a", "automatic", "single", "tanto"), ("NY", "b", "OTF", None, None), ("IL", "c", "manual", "double", "dagger"), ("MI", "d", "automatic", "single", "drop point"), ("MI", "e", "manual", "double", None), ("MI", "f", None, None, "dirk"), ("TX", "g", "OTF", "double", "dagger"), ("CA", "h", None, None, None), (None, "i", "OTF", "double", "dagger")],
        "state string, sku string, opening string, edge_count string, blade_shape string",
    )
    assert sorted(r["sku"] for r in rules.violations(shown).collect()) == ["a", "b", "e", "f"]
    assert rules.violations(shown, {}).count() == 0


def test_aliases_meet_their_collections(spark):
    linked = spark.createDataFrame([("camping-knives",), ("camping-knives",), ("fillet-knives",), ("new",)], "slug string")
    declared = spark.createDataFrame([("camping-survival-knives",), ("fillet-bait-knives",), ("tools",)], "slug string")
    aliases = spark.createDataFrame([("camping-knives", "camping-survival-knives"), ("fillet-knives", "fillet-bait-knives")], "alias string, slug string")
    assert sorted(map(tuple, joins.unmatched(linked, declared, "slug", aliases).collect())) == [("new", "left"), ("tools", "right")]
    assert joins.unmatched(linked, declared, "slug").count() == 6


def test_seasons_of_a_table(spark):
    seasons = spark.createDataFrame(
        [("OH", "all", "archery", date(2026, 9, 26), date(2027, 2, 7), "x"), ("OH", "all", "gun", date(2026, 11, 30), date(2026, 12, 6), "x"), ("FL", "land", "hog", date(2026, 1, 1), None, "x")],
        "state string, zone string, weapon string, open date, close date, agency string",
    )
    rows = spark.createDataFrame([("OH", date(2026, 12, 6), 1), ("OH", date(2027, 2, 8), 2), ("OH", date(2027, 1, 1), 3), ("FL", date(2030, 5, 5), 4), ("TX", date(2026, 12, 1), 5)], "state string, day date, i int")
    found = sorted((r["i"], r["weapon"]) for r in joins.open_seasons(rows, seasons, "state", "day").collect())
    assert found == [(1, "archery"), (1, "gun"), (3, "archery"), (4, "hog")]


def test_worklist_bounds(spark):
    rows = [("a", 5.0, 51, 0), ("b", 20.0, 1000, 14), ("c", 4.99, 100, 0), ("d", 20.01, 100, 0), ("e", 10.0, 50, 0), ("f", 10.0, 1000, 15), ("g", None, 100, 0), ("h", 10.0, 0, 0), ("i", 10.0, 10, 0)]
    searched = spark.createDataFrame(rows, "url string, position double, impressions long, clicks long")
    assert sorted(r["url"] for r in ranking.worklist(searched).collect()) == ["a", "b"]
    assert sorted(r["url"] for r in ranking.worklist(searched, impressions=None).collect()) == ["a", "b", "e", "i"]


def brute_similar(rows, l_tol, p_tol, most):
    out = []
    for k, l, p in rows:
        near = sorted((abs(p - p2), abs(l - l2), k2) for k2, l2, p2 in rows if k2 != k and abs(p - p2) <= p_tol and abs(l - l2) <= l_tol)
        out += [(k, k2, i) for i, (_, _, k2) in enumerate(near[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_similar_equals_brute_force(spark, seed):
    """Prices on a grid, so that there are many ties, in buckets that hold far more products than are asked for."""
    rng = random.Random(seed)
    rows = [(k, rng.randint(1, 9), rng.randint(0, 40) / 4) for k in range(300)] + [(1000 + k, 5, 3.0) for k in range(30)]
    table = spark.createDataFrame([*rows, (5000, None, 1.0), (5001, 3, None)], "sku long, size int, price double")
    found = joins.similar(table, "sku", "size", "price", 2, 0.5, most=3 + seed)
    assert sorted(map(tuple, found.collect())) == brute_similar(rows, 2, 0.5, 3 + seed)


def test_similar_is_linear(spark, monkeypatch):
    """Products of one length and price: rows that meet grow with the products, not with their square."""
    table = spark.range(3000).select(F.col("id").alias("sku"), F.lit(5).alias("size"), F.lit(9.5).alias("price"))
    found = joins.similar(table, "sku", "size", "price", 1, 0.25)
    assert found.count() == 12_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


def test_curated_lists_alone_are_made_distinct(spark):
    products = spark.createDataFrame([("a", True), ("a", True)], "sku string, is_knife boolean")
    found = rules.membership(products, {"k": rules.parse("All knives")}, "sku", spark.createDataFrame([("c", "a"), ("c", "a")], "slug string, sku string"))
    assert sorted(map(tuple, found.collect())) == [("c", "a"), ("k", "a"), ("k", "a")]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Union") < text.index("Aggregate")  # below the union, on the list's side only


def test_pages_of_more_products_than_a_small_dimension(spark, sf_dir):
    t = Tables(spark, sf_dir)
    products = spark.range(10_050).select(F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("slug"), F.lit("n").alias("name"), F.lit("b").alias("brand"), F.lit(1).alias("blade"), F.lit("s").alias("steel"), F.lit(2).alias("rrp"), F.lit(1).alias("price"))
    cards = assemble.product_cards(pages.states(t).limit(2), products, assemble.Site()).select(F.size(F.regexp_extract_all("cards", F.lit("(<article>)"), F.lit(1))).alias("n")).collect()
    assert [r["n"] for r in cards] == [10_050, 10_050]


def test_page_words_are_parameters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    siblings = t.nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))
    brands = t.region.select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"))
    made = assemble.state_pages(pages.states(t), pages._products(t), brands, siblings, None, assemble.Site(hub="All Places", page="Blades of {name}", home="Start"))
    row = made.orderBy("slug").first()
    assert '"name":"Blades of ' in row["json_ld"] and "All Places" in row["json_ld"] and '"name":"Start"' in row["json_ld"] and "0 products" in row["html"]


def test_a_timer_needs_no_further_event(spark, tmp_path):
    """A loads and reads on; only B's later event moves the watermark. B's own timer hasn't gone off by then; C came late for it."""
    day = lambda h, m, s: datetime(2024, 1, 1, h, m, s)
    files = [[(1, day(8, 0, 0), 10), (2, day(8, 0, 1), 10), (3, day(8, 0, 9), 30)], [(4, day(10, 0, 0), 20)], [(5, day(10, 0, 4), 30), (6, day(10, 30, 0), 20)]]
    import os

    for k, rows in enumerate(files):
        spark.createDataFrame([(*r, "view", 0.0, "{}") for r in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/w{k}") if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/w{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    from larkspur.plans.streams import EVENTS

    fired = runs.available_now(visitors.fire_after(visitors.read_events(spark, f"{tmp_path}/in", EVENTS, "*.parquet", 1)))
    ms = lambda t: int(t.timestamp() * 1000)
    from datetime import timezone

    utc = lambda t: ms(t.replace(tzinfo=timezone.utc))
    assert sorted((r["user_id"], r["fired_ms"]) for r in fired.collect()) == [(10, utc(day(8, 0, 5))), (30, utc(day(8, 0, 14)))]


def test_no_query_is_cut_by_an_id(spark):
    """The SQL of no query over products names a range or a remainder of keys, but where that stands for an attribute."""
    registry.load()
    stand_ins = {"jn6_collection_membership", "jn6_membership_by_index", "jn6_collection_counts", "jn8_collections_with_products", "fl12_curated_membership", "jn9_compliance_violations"}
    assert {k for k, sql in registry.ORACLE_SQL.items() if "p_partkey %" in sql or "p_partkey <" in sql.replace("p_partkey <>", "")} <= stand_ins
