"""Bundles are built and checked for every product."""

from larkspur.plans import joins
from larkspur.plans.registry import Tables

PART = 900


def parts(spark, tmp_path):
    """More products than any range of keys in the SQL."""
    spark.range(PART).selectExpr(
        "id AS p_partkey", "concat('widget ', id) AS p_name", "concat('Brand#', id % 9) AS p_brand", "IF(id % 3 = 0, 'PROMO', 'LARGE') AS p_type",
        "CAST(id % 50 + 1 AS INT) AS p_size", "900.0D + (id * 37 % 1000) AS p_retailprice",
    ).write.parquet(f"{tmp_path}/part.parquet")
    return Tables(spark, str(tmp_path))


def test_every_product_has_a_bundle(spark, tmp_path):
    t = parts(spark, tmp_path)
    price = {k: 900.0 + k * 37 % 1000 for k in range(PART)}
    total = lambda k, n: sum(price.get(k + i, 0) for i in range(n))
    found = {r["bundle_id"]: (r["n_items"], round(r["total"], 6), round(r["saving"], 6)) for r in joins.every_bundle(t, 3).collect()}
    assert found == {k: (min(3, PART - k), total(k, 3), round(total(k, 3) - 2.7 * price[k], 6)) for k in price}
    costly = {r["bundle_id"] for r in joins.every_costly_bundle(t).collect()}
    assert costly == {k for k in price if 2.7 * price[k] >= total(k, 2)} and any(k % 50 for k in costly)
    assert {r["bundle_id"] for r in joins.bundles(t).collect()} == set(price)
    assert {r["bundle_id"] for r in joins.costly_bundles(t).collect()} == costly
