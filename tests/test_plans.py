"""Properties of physical plans that scale depends on."""

import re

import pytest

from larkspur.plans import registry

registry.load()


def plan(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "pushed"), [("fl3_equality", "EqualTo(p_type,PROMO)"), ("fl13_brand", "EqualTo(p_brand,Brand#7)"), ("fl4_disjunction", "In(p_type,[LARGE,PROMO])")])
def test_facets_reach_the_scan(spark, sf_dir, name, pushed):
    text = plan(spark, sf_dir, name).replace(" ", "")
    assert pushed in text or pushed.replace("[LARGE,PROMO]", "[PROMO,LARGE]") in text


@pytest.mark.parametrize(("name", "unread"), [("jn6_collection_counts", "p_name"), ("ag6_cart_subtotal", "l_shipdate"), ("wn3_recently_viewed", "value"), ("ag12_duplicate_copy", "source")])
def test_unused_columns_are_not_read(spark, sf_dir, name, unread):
    assert all(unread not in schema for schema in re.findall(r"ReadSchema: struct<([^>]*)", plan(spark, sf_dir, name)))


@pytest.mark.parametrize("name", ["jn12_related_by_brand", "jn13_similar_products", "jn7_links_against_declared", "jn16_two_clicks", "d_asof_last_click", "d_revenue_by_nation"])
def test_large_tables_never_meet_in_nested_loops(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, sf_dir, name))


def test_rules_are_one_scan(spark, sf_dir):
    # The other scan is that of the hand-kept list.
    assert plan(spark, sf_dir, "jn6_collection_membership").count("FileScan parquet") == 2


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.endswith("_stream")))
def test_no_python_on_executors(spark, sf_dir, name):
    if name[:2] in ("sc", "sk", "jn", "fl", "wn", "ag", "ss", "d_", "l1", "dt"):
        assert not re.search("Python|Pandas|Arrow", plan(spark, sf_dir, name))


@pytest.mark.parametrize("name", ["wn3_recently_viewed", "or6_spokes_per_hub", "wn4_product_lists"])
def test_tops_are_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(spark, sf_dir, name)
