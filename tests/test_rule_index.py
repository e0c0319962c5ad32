"""Membership by the index of terms against the compiled rules, over ten rules and ten thousand."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspur.operators import rule_index, rules

PRODUCTS = "sku long, brand string, opening string, blade_length decimal(5,2), price decimal(10,2), stock int, is_knife boolean, attributes string"
ATTRIBUTES = ["brand", "opening", "blade_length", "price", "stock", "is_knife"]


def made(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice([*xs, None])
    return [(i, pick(*(f"B{k}" for k in range(30))), pick("manual", "assisted", "automatic", "OTF"), pick(*(Decimal(k) / 4 for k in range(60))), pick(Decimal("0.00"), Decimal("-1.50"), Decimal("99999999.99"), Decimal(rng.randrange(30000)) / 100), pick(0, 5, 12), pick(True, False), "x") for i in range(n)]


def cells(n, seed=2):
    rng = random.Random(seed)

    def term():
        return rng.choice([
            f"brand = B{rng.randrange(35)}", f"brand = B{rng.randrange(30)} OR B{rng.randrange(30)}", "opening = manual/assisted", "opening NOT automatic/OTF", f"brand NOT B{rng.randrange(30)}",
            f"blade_length < {rng.randrange(70) / 4}", f"blade_length <= {rng.randrange(70) / 4}", f"price < {rng.randrange(40000) / 100}", f"price <= {rng.choice(['-1.5', '0', '99999999.99', '300'])}", "stock <= 5", "opening = OTF",
        ])

    return [" AND ".join(term() for _ in range(rng.randint(1, 3))) for _ in range(n)]


def table(spark, found):
    return spark.createDataFrame([(f"r{i}", c) for i, c in enumerate(found)], "slug string, filter_rule string").repartition(3)


def test_membership_is_that_of_the_compiled_rules(spark):
    products = spark.createDataFrame(made(300), PRODUCTS).repartition(4)
    found = [*cells(120), "All knives", "All knives (exclude ballistic)", "Curated", "Existing category", "Gut hooks, skinners", " opening = manual "]
    compiled = {f"r{i}": rules.parse(c, f"r{i}") for i, c in enumerate(found)}
    curated = products.where("sku < 3").select(F.lit("r122").alias("slug"), "sku")
    assert sorted(map(tuple, rule_index.members(products, table(spark, found), "sku", ATTRIBUTES, curated).collect())) == sorted(map(tuple, rules.membership(products, compiled, "sku", curated).collect()))


def plain(product, cell):
    """Whether a product meets a rule, term by term."""
    values = dict(zip(PRODUCTS.replace(",", "").split()[::2][1:6], product[1:6], strict=False))
    for part in cell.split(" AND "):
        name, op, value = part.split(" ", 2)
        own = dict(brand=product[1], opening=product[2], blade_length=product[3], price=product[4], stock=product[5])[name]
        if own is None:
            return False
        options = [v.strip() for v in value.replace(" OR ", "/").split("/")]
        if not {"=": lambda: own in options, "NOT": lambda: own not in options, "<": lambda: own < Decimal(value), "<=": lambda: own <= Decimal(value)}[op]():
            return False
    return bool(values)


def test_ten_thousand_rules(spark):
    """No driver loop: the plan is as large as for one rule."""
    rows, found = made(40, 5), cells(10_000, 6)
    products = spark.createDataFrame(rows, PRODUCTS)
    out = rule_index.members(products, table(spark, found), "sku", ATTRIBUTES)
    expected = sorted((f"r{i}", p[0]) for i, c in enumerate(found) for p in rows if plain(p, c))
    assert sorted(map(tuple, out.collect())) == expected
    depth = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert depth(out) == depth(rule_index.members(products, table(spark, found[:1]), "sku", ATTRIBUTES))


@pytest.mark.parametrize("cell", ["opening > manual", "price < cheap", "nonsense", "price < 1.005", "= x", ""])
def test_other_cells_fail(spark, cell):
    with pytest.raises(Exception, match="not a rule"):
        rule_index.parse_cells(table(spark, [cell])).collect()


def test_no_rules_no_products_and_null_cells(spark):
    products = spark.createDataFrame(made(5), PRODUCTS)
    none = spark.createDataFrame([("a", None)], "slug string, filter_rule string")
    assert rule_index.members(products, none, "sku", ATTRIBUTES).collect() == []
    assert rule_index.members(products, none.limit(0), "sku", ATTRIBUTES).collect() == []
    assert rule_index.members(products.limit(0), table(spark, ["opening = manual"]), "sku", ATTRIBUTES).collect() == []


def test_only_rules_met_by_their_rarest_term_are_checked(spark):
    """A rule of a rare brand and a common exclusion has one entry, its brand's."""
    products = spark.createDataFrame(made(300), PRODUCTS)
    described = products.select("sku", F.map_filter(F.create_map(F.lit("brand"), F.col("brand"), F.lit("opening"), F.col("opening")), lambda _, v: v.isNotNull()).alias("attributes"))
    found = rule_index.index(rule_index.parse_cells(table(spark, ["opening NOT OTF AND brand = B1 AND opening = manual/assisted"])), described).collect()
    assert [(r["attribute"], r["key"]) for r in found] == [("brand", "=B1")]


@pytest.mark.parametrize(("sent", "how"), [(rule_index.SENT, "broadcast"), (0, "merge")])
def test_the_products_are_never_the_side_that_is_sent(spark, tmp_path, monkeypatch, sent, how):
    """A table of products that is small as a file, and an index of either size: the rules are the built side, by a hint that no estimate overrules."""
    monkeypatch.setattr(rule_index, "SENT", sent)
    rows, found = made(300, 7), cells(200, 8)
    spark.createDataFrame(rows, PRODUCTS).coalesce(1).write.parquet(str(tmp_path / "products"))
    out = rule_index.members(spark.read.parquet(str(tmp_path / "products")), table(spark, found), "sku", ATTRIBUTES)
    assert sorted(map(tuple, out.collect())) == sorted((f"r{i}", p[0]) for i, c in enumerate(found) for p in rows if plain(p, c))
    assert f"rightHint=(strategy={how})" in out._jdf.queryExecution().optimizedPlan().toString()
