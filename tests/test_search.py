"""The index against scans."""

import math
import random

import pytest

from larkspur.functions import text
from larkspur.operators import search

WORDS = ["red", "Red-dot", "bolt", "cold", "gear", "a", "über", "old", "100%", "re"]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(300)] + [(1000, None), (1001, "  \t "), (1002, " RED\n red\tred "), (1003, "x" * 50_000)]
    frame = spark.createDataFrame(rows, "sku long, name string").repartition(3)
    path = str(tmp_path_factory.mktemp("index"))
    search.build(frame, path, "sku", "name")
    return frame, path, rows


@pytest.mark.parametrize("query", ["red", "Bolt red", "re ol", "ÜBER", "%", "red red", "zzz", "red zzz", "", "  ", "xx", "d-d a"])
def test_same_hits_as_a_scan(spark, shop, query):
    frame, path, _ = shop
    scan = frame.where(text.site_search(frame["name"], query)) if query.split() else frame.limit(0)
    assert sorted(r["key"] for r in search.hits(spark, path, query).collect()) == sorted(r["sku"] for r in scan.collect())


def test_order_and_ties(spark, shop):
    _, path, rows = shop
    terms = {i: (n or "").lower().split() for i, n in rows}
    df = {w: sum(w in t for t in terms.values()) for w in {x for t in terms.values() for x in t}}
    score = {i: round(sum(math.log(1 + len(rows) / df[x]) for w in ("re", "ol") for x in t if w in x), 6) for i, t in terms.items() if all(any(w in x for x in t) for w in ("re", "ol"))}
    best = sorted(score, key=lambda i: (-score[i], i))[:20]
    found = sorted(search.top(spark, path, "ol re", 20).collect(), key=lambda r: r["rank"])
    assert [r["key"] for r in found] == best and [r["rank"] for r in found] == list(range(1, 21))
    assert all(abs(r["score"] - score[r["key"]]) < 1e-5 for r in found) and len(set(score.values())) < len(score)


def test_only_the_parts_of_the_terms_found_are_read(spark, shop):
    _, path, _ = shop
    plan = search.hits(spark, path, "bolt")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "dynamicpruning" in plan


def test_an_empty_table(spark, tmp_path):
    search.build(spark.createDataFrame([], "sku long, name string"), str(tmp_path), "sku", "name")
    assert search.top(spark, str(tmp_path), "red", 5).collect() == []
