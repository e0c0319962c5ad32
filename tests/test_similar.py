"""Similar products and pairings where many rows agree."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import joins, ranking


def plain(rows, length_tolerance, price_tolerance, most):
    out = []
    for k, l, p in rows:
        near = sorted((abs(p - p2), abs(l - l2), k2) for k2, l2, p2 in rows if k2 != k and abs(p - p2) <= price_tolerance and abs(l - l2) <= length_tolerance)
        out += [(k, x[2], r) for r, x in enumerate(near[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("prices", "lengths", "seed"), [(3, 2, 1), (40, 9, 2), (4000, 30, 3), (1, 1, 4), (200, 1, 5)])
def test_against_all_pairs(spark, prices, lengths, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(lengths), rng.randrange(prices) / 16) for i in range(240)]
    frame = spark.createDataFrame([*rows, (None, 1, 1.0), (998, None, 1.0), (999, 1, None)], "k long, l int, p double").repartition(4)
    assert sorted(map(tuple, joins.similar(frame, "k", "l", "p", 3, 0.25).collect())) == plain(rows, 3, 0.25, 4)


def test_a_hundred_thousand_products_at_one_price(spark):
    rows = spark.range(100_000).select(F.col("id").alias("k"), F.lit(5).alias("l"), F.lit(9.99).alias("p"))
    rows = rows.unionByName(spark.createDataFrame([(200_000, 6, 9.99), (200_001, 5, 10.0)], "k long, l int, p double"))
    found = joins.similar(rows, "k", "l", "p", 3, 0.25)
    assert found.count() == 4 * 100_002
    by = {r["k"]: sorted((x["rank"], x["s"]) for x in r["x"]) for r in found.where("k in (0, 3, 99999, 200000, 200001)").groupBy("k").agg(F.collect_list(F.struct("rank", F.col("similar_k").alias("s"))).alias("x")).collect()}
    assert by == {0: [(1, 1), (2, 2), (3, 3), (4, 4)], 3: [(1, 0), (2, 1), (3, 2), (4, 4)], 99999: [(i + 1, i) for i in range(4)], 200000: [(i + 1, i) for i in range(4)], 200001: [(i + 1, i) for i in range(4)]}


def test_pairings_with_a_dimension_over_the_bound(spark):
    left, many = spark.createDataFrame([(1,), (2,)], "a int"), spark.range(10_001).select((F.col("id") % 10_000).alias("b"), F.lit(None).cast("string").alias("c"))
    assert joins.with_each(left, many).count() == 20_002
    few = joins.with_each(left, many, most=3000)
    assert few.columns == ["a", "b", "c"] and few.distinct().count() == 20_000 and few.agg(F.sum("b")).first()[0] == 2 * sum(range(10_000))


def test_gapless_numbers(spark):
    found = ranking.gapless(spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v")), ["v"]).collect()
    assert sorted((r["index"], r["v"]) for r in found) == [(i, i) for i in range(3000)]
    assert ranking.gapless(spark.range(0).select(F.col("id").alias("v")), ["v"]).collect() == []
    tied = ranking.gapless(spark.range(500).select(F.lit(1).alias("v")), ["v"]).collect()
    assert sorted(r["index"] for r in tied) == list(range(500))
