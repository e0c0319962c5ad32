import pytest
from pyspark.sql import functions as F

from larkspur.operators import aggregates, joins, ranking
from larkspur.sources import sinks, tables


def test_strict_lookup_fails_on_a_missing_key(spark):
    left = spark.createDataFrame([("a",), ("b",)], "slug string")
    right = spark.createDataFrame([("a", 1)], "slug string, n int")
    with pytest.raises(Exception, match="no slug: b"):
        joins.strict_lookup(left, right, "slug").collect()
    assert joins.strict_lookup(left.where("slug = 'a'"), right, "slug").first()["n"] == 1


def test_pairing_cuts_large_dimensions_in_pieces(spark):
    """Columns of one name on both sides stay two."""
    paired = joins.with_each(spark.range(3), spark.range(20), most=8)
    assert sorted(map(tuple, paired.collect())) == [(i, j) for i in range(3) for j in range(20)]


def test_unmatched_has_both_directions(spark):
    linked = spark.createDataFrame([("best-sellers",), ("knives",), ("knives",)], "slug string")
    declared = spark.createDataFrame([("knives",), ("optics",)], "slug string")
    assert sorted(tuple(r) for r in joins.unmatched(linked, declared, "slug").collect()) == [("best-sellers", "left"), ("optics", "right")]


def test_related_never_names_itself(spark):
    rows = spark.createDataFrame([(k, "x" if k < 7 else "y", float(k)) for k in range(8)], "sku long, brand string, price double")
    found = joins.related(rows, "sku", "brand", [F.desc("price"), F.asc("sku")]).collect()
    assert all(r["sku"] != r["related_sku"] for r in found)
    assert [r["related_sku"] for r in sorted((r for r in found if r["sku"] == 6), key=lambda r: r["rank"])] == [5, 4, 3, 2]
    assert not [r for r in found if r["sku"] == 7]


def test_reachable_counts_fewest_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("c", "a")], "src string, dst string")
    found = joins.reachable(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r["node"]: r["hops"] for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_ordered_text_keeps_the_order_not_the_arrival(spark):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (2, "b2")], "ord int, x string").repartition(3)
    assert aggregates.ordered_text(rows, [], ["ord", "x"], "x", "-").first()["listing"] == "a-b-b2-c"


def test_ratings_have_all_stars(spark):
    reviews = spark.createDataFrame([("a", 5), ("a", 4), ("a", None), ("b", None)], "sku string, rating int")
    r = aggregates.rating_summary(reviews, "sku", "rating").collect()
    assert len(r) == 1 and r[0]["n_reviews"] == 2 and r[0]["rating"] == 4.5 and [r[0][f"pct_{k}"] for k in range(1, 6)] == [0, 0, 0, 50, 50]


def test_exactly_one_primary(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True), ("c", False)], "sku string, main boolean")
    assert {r["sku"]: r["n"] for r in aggregates.not_exactly_one(rows, "sku", F.col("main")).collect()} == {"b": 2, "c": 0}


def test_recents_keep_twelve_latest(spark):
    views = spark.createDataFrame([(1, k % 15, k, k) for k in range(40)] + [(2, 9, 1, 99)], "u long, k long, ts long, id long")
    found = sorted((r["rank"], r["k"]) for r in ranking.recents(views, "u", "k", "ts", "id").where("u = 1").collect())
    assert [k for _, k in found] == [k % 15 for k in range(39, 27, -1)]


def test_repeat_zero_times(spark):
    assert ranking.repeated(spark.range(1), F.lit(0)).count() == 0


def test_csv_with_quoted_commas_and_sentinels(spark, tmp_path):
    (tmp_path / "c.csv").write_text('slug,title,group,filter_rule,attributes_needed,build_priority,notes\na,"A, with comma",core,Curated,none,1,\nb,B – dash,state,opening = manual,opening,2,note\n', encoding="utf-8")
    rows = {r["slug"]: r for r in tables.state_collections(spark, str(tmp_path / "c.csv")).collect()}
    assert rows["a"]["title"] == "A, with comma" and rows["a"]["attributes_needed"] is None and rows["a"]["notes"] is None
    assert rows["b"]["title"] == "B – dash" and rows["b"]["build_priority"] == 2


def test_indexable_must_be_yes_or_no(spark, tmp_path):
    (tmp_path / "c.csv").write_text("slug,title,group,url_pattern,driven_by,indexable,priority,notes\na,A,g,/x/,y,MAYBE,1,\n", encoding="utf-8")
    with pytest.raises(Exception, match="indexable: MAYBE"):
        tables.product_collections(spark, str(tmp_path / "c.csv")).collect()


def test_pages_replace_older_ones(spark, tmp_path):
    path = str(tmp_path / "pages")
    for text in ("old", "new"):
        sinks.write_pages(spark.createDataFrame([("a", text), ("b", text)], "slug string, html string"), path)
    assert sorted(tuple(r) for r in spark.read.text(path).select("slug", "value").collect()) == [("a", "new"), ("b", "new")]
