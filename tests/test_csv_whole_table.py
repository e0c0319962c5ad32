"""Round trips through CSV take the whole table, and its two shapes with all kinds of rules."""

from decimal import Decimal

from pyspark.sql import functions as F

from larkspur.operators import rules
from larkspur.plans import catalogue
from larkspur.plans.registry import Tables
from larkspur.sources import tables

PART = 900


def parts(spark, tmp_path):
    """More products than any range of keys in the SQL."""
    spark.range(PART).selectExpr(
        "id AS p_partkey", "concat('widget ', id) AS p_name", "concat('Brand#', id % 9) AS p_brand", "IF(id % 3 = 0, 'PROMO', 'LARGE') AS p_type",
        "CAST(id % 50 + 1 AS INT) AS p_size", "900.0D + (id * 37 % 1000) AS p_retailprice",
    ).write.parquet(f"{tmp_path}/part.parquet")
    return Tables(spark, str(tmp_path))


def test_whole_table_goes_through_csv(spark, tmp_path):
    t = parts(spark, tmp_path)
    assert sorted(int(r["notes"]) for r in catalogue.written_collections(t).collect()) == list(range(PART))
    assert {int(r["slug"]): r["indexable"] for r in catalogue.written_flags(t).collect()} == {k: k % 50 + 1 > 10 for k in range(PART)}
    assert {int(r["url"]): (r["position"], r["clicks"]) for r in catalogue.written_search(t).collect()} == {k: ((900 + k * 37 % 1000) / 50, k % 50 + 1) for k in range(PART)}
    assert [q(t).count() for q in (catalogue.csv_scan, catalogue.csv_flags, catalogue.search_export)] == [PART] * 3


def test_queries_write_the_whole_table(spark, tmp_path, monkeypatch):
    t = parts(spark, tmp_path)
    monkeypatch.setattr(catalogue, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    for name, q in (("state_collections", catalogue.csv_scan), ("product_collections", catalogue.csv_flags), ("search", catalogue.search_export)):
        q(t).collect()
        assert spark.read.option("header", True).csv(f"{tmp_path}/{name}").count() == PART


CELLS = [
    ("core-list", "Existing category", "none"), ("folders", "blade_type = folding", "blade_type"), ("autos", "opening = automatic OR OTF", "opening"),
    ("one-edge", "edge_count = single AND blade_shape NOT dagger/stiletto/dirk", "edge_count + blade_shape"), ("no-ballistic", "All knives (exclude ballistic)", "none"),
    ("hand-folders", "opening = manual/assisted AND blade_type = folding", "opening + blade_type"), ("every-knife", "All knives", "none"),
    ("up-to-12", "blade_length <= 12", "blade_length"), ("under-5-5", "blade_length < 5.5", "blade_length"), ("season", "Curated", "none"), ("hooks", "Gut hooks, skinners, caping blades", "none"),
]


def test_rules_from_a_file(spark, tmp_path):
    """A file of the states' shape with all kinds of cells: read, parsed, and applied to products in one pass."""
    lines = ["slug,title,group,filter_rule,attributes_needed,build_priority,notes"] + [f'{slug},"{slug}, titled – so",state,"{cell}",{needed},1,' for slug, cell, needed in CELLS]
    (tmp_path / "state.csv").write_text("\n".join(lines), encoding="utf-8")
    cells = {r["slug"]: r["filter_rule"] for r in tables.state_collections(spark, str(tmp_path / "state.csv")).collect()}
    assert cells == {slug: cell for slug, cell, _ in CELLS}
    products = spark.createDataFrame(
        [("fold", "manual", "folding", "3.5", "single", "drop point", True), ("auto", "automatic", "folding", "3.9", "single", "clip point", True), ("dagger", "manual", "fixed", "6.0", "single", "dagger", True), ("sword", "manual", "fixed", "12.0", "double", None, True), ("unknown", None, None, None, "single", None, True), ("stone", None, None, None, None, None, False)],
        "sku string, opening string, blade_type string, blade_length string, edge_count string, blade_shape string, is_knife boolean",
    ).withColumn("blade_length", F.col("blade_length").cast("decimal(5,2)"))
    curated = spark.createDataFrame([("season", "stone"), ("season", "stone"), ("hooks", "fold"), ("core-list", "auto")], "slug string, sku string")
    found = rules.membership(products, {slug: rules.parse(cell, slug) for slug, cell in cells.items()}, "sku", curated)
    by_slug = {}
    for r in found.collect():
        by_slug.setdefault(r["slug"], []).append(r["sku"])
    knives = ["auto", "dagger", "fold", "sword", "unknown"]
    assert {k: sorted(v) for k, v in by_slug.items()} == {
        "core-list": ["auto"], "folders": ["auto", "fold"], "autos": ["auto"], "one-edge": ["auto", "fold"], "no-ballistic": knives, "hand-folders": ["fold"],
        "every-knife": knives, "up-to-12": ["auto", "dagger", "fold", "sword"], "under-5-5": ["auto", "fold"], "season": ["stone"], "hooks": ["fold"],
    }


def test_flags_from_a_file(spark, tmp_path):
    (tmp_path / "product.csv").write_text('slug,title,group,url_pattern,driven_by,indexable,priority,notes\nhunting,"Hunting, all",primary_category,/collections/,manual assignment,YES,1,"Never, ever"\nunder-25,Under $25,price_facet,/collections/,price < 25,NO,3,\n', encoding="utf-8")
    rows = {r["slug"]: r for r in tables.product_collections(spark, str(tmp_path / "product.csv")).collect()}
    assert rows["hunting"]["indexable"] is True and rows["under-25"]["indexable"] is False and rows["hunting"]["notes"] == "Never, ever"
    assert rules.parse(rows["under-25"]["driven_by"]) == rules.Bound("price", high=Decimal(25), high_included=False)
