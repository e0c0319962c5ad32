"""Feeds against the feed before."""

import pytest

from larkspur.operators import feeds

FEED = "sku string, opening string, blade_type string, edge_count string, price decimal(10,2)"


def feed(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame([(s, o, b, e, None if p is None else Decimal(p)) for s, o, b, e, p in rows], FEED)


BEFORE = [("same", "manual", "folding", None, "5"), ("old", "manual", None, None, "5"), ("dear", "manual", None, None, "5"), ("bad", "manual", None, None, "5"), ("was-bad", "pedal", None, None, "5"), ("null", None, None, None, None)]
AFTER = [("same", "manual", "folding", None, "5.00"), ("dear", "manual", None, None, "6"), ("bad", "lever", "bent", None, "0"), ("new", "OTF", "fixed", "single", "1"), ("new-bad", "manual", None, "triple", "1"), ("null", None, None, "single", None), ("was-bad", "pedal", None, None, "5"), (None, "x", "x", "x", "1")]


def test_changes_are_told_and_only_they_are_validated(spark):
    catalogue, log, quarantine = feeds.imported(feed(spark, *BEFORE), feed(spark, *AFTER))
    assert sorted(map(tuple, log.collect())) == [("bad", "changed", True), ("dear", "changed", False), ("new", "inserted", False), ("new-bad", "inserted", True), ("null", "changed", False), ("old", "removed", False)]
    assert {r["sku"]: r["faults"] for r in quarantine.collect()} == {"bad": ["blade_type=bent", "opening=lever", "price=0.00"], "new-bad": ["edge_count=triple"]}
    kept = {r["sku"]: (r["opening"], r["edge_count"], None if r["price"] is None else float(r["price"])) for r in catalogue.collect()}
    assert kept == {"same": ("manual", None, 5.0), "dear": ("manual", None, 6.0), "bad": ("manual", None, 5.0), "new": ("OTF", "single", 1.0), "null": (None, "single", None), "was-bad": ("pedal", None, 5.0)}


def test_a_null_is_not_an_empty_text_and_repeated_rows_are_one(spark):
    before, after = feed(spark, ("a", None, None, None, "1"), ("a", None, None, None, "1")), feed(spark, ("a", "", None, None, "1"))
    assert list(map(tuple, feeds.changes(before, after).collect())) == [("a", "changed")]
    assert feeds.changes(before, before).collect() == [] and feeds.changes(before.limit(0), before.limit(0)).collect() == []


def test_two_different_rows_of_a_key_fail(spark):
    with pytest.raises(Exception, match="two rows of a"):
        feeds.changes(feed(spark), feed(spark, ("a", None, None, None, "1"), ("a", None, None, None, "2"))).collect()


def test_a_new_column_changes_the_rows_that_have_it(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2)], "sku string, n int")
    after = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "sku string, n int, m string")
    assert list(map(tuple, feeds.changes(before, after).collect())) == [("b", "changed")]
