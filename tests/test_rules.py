from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspur.operators import rules
from larkspur.sources.tables import SCHEMAS

ATTRS = "sku string, opening string, blade_type string, blade_length decimal(5,2), edge_count string, blade_shape string, is_knife boolean"
PRODUCTS = [
    ("a", "manual", "folding", Decimal("3.50"), "single", "drop point", True),
    ("b", "OTF", "folding", Decimal("5.50"), "single", "dagger", True),
    ("c", "assisted", "fixed", Decimal("12.00"), "double", "drop point", True),
    ("d", "automatic", "folding", Decimal("12.01"), "single", None, True),
    ("e", None, None, None, None, None, True),
    ("f", None, None, None, None, None, False),  # a sharpener
    ("g", None, None, None, None, None, None),
]


@pytest.fixture
def products(spark):
    return spark.createDataFrame(PRODUCTS, ATTRS)


def held(products, rule):
    return "".join(sorted(r["sku"] for r in products.where(rule.condition()).collect()))


@pytest.mark.parametrize(
    ("cell", "skus"),
    [
        ("blade_type = folding", "abd"),
        ("opening = automatic OR OTF", "bd"),
        ("opening = manual/assisted", "ac"),
        ("opening = manual/assisted AND blade_type = folding", "a"),
        ("edge_count = single AND blade_shape NOT dagger/stiletto/dirk", "a"),
        ("blade_length <= 12", "abc"),
        ("blade_length < 5.5", "a"),
        ("All knives", "abcde"),
        ("All knives (exclude ballistic)", "abcde"),
        ("Curated", ""),
        ("Existing category", ""),
        ("Gut hooks, skinners, caping blades", ""),
    ],
)
def test_cells(products, cell, skus):
    assert held(products, rules.parse(cell)) == skus


@pytest.mark.parametrize("cell", ["", "sharp ones", "blade_length > many", "opening ~ x"])
def test_other_cells_are_refused(cell):
    with pytest.raises(Exception):
        rules.parse(cell)


def test_flags_agree_with_filters(products):
    for cell in ("blade_type = folding", "edge_count = single AND blade_shape NOT dagger", "blade_length <= 12"):
        rule = rules.parse(cell)
        assert held(products, rule) == "".join(sorted(r["sku"] for r in products.where(rule.column()).collect()))
    either = rules.Any((rules.parse("blade_shape NOT dagger"), rules.parse("opening = automatic")))
    assert held(products, either) == "acd"


def test_missing_attribute_fails_closed_also_in_a_flag(products):
    flags = products.select("sku", rules.parse("blade_shape NOT dagger").column().alias("f")).collect()
    assert {r["sku"]: r["f"] for r in flags} == {"a": True, "b": False, "c": True, "d": False, "e": False, "f": False, "g": False}


def test_membership_is_one_scan(products, spark):
    curated = spark.createDataFrame([("picks", "e"), ("picks", "e")], "slug string, sku string")
    found = rules.membership(products, {"all": rules.parse("All knives"), "auto": rules.parse("opening = automatic OR OTF"), "picks": rules.parse("Curated")}, "sku", curated)
    assert sorted((r["slug"], r["sku"]) for r in found.collect()) == [("all", s) for s in "abcde"] + [("auto", "b"), ("auto", "d"), ("picks", "e")]
    plan = rules.membership(products, {"x": rules.parse("blade_length < 5.5"), "y": rules.parse("All knives")}, "sku")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_rule_attributes():
    assert rules.parse("edge_count = single AND blade_shape NOT dagger").attributes() == {"edge_count", "blade_shape"}
    assert rules.parse("All knives").attributes() == {"is_knife"} and rules.All().attributes() == frozenset()


def test_rules_reach_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/part.parquet").where(rules.In("p_type", ("PROMO",)).condition()).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,PROMO)" in plan.replace(" ", "") and "p_name" not in plan


def test_schemas_parse(spark):
    for ddl in SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns
    assert F is not None
