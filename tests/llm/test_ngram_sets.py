"""The n-gram join beyond plain tables: hot runs, repeated ids, long texts, odd columns; and one row of each class."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pair_operators import brute_classes, closure, near_copies

from larkspur.llm import blocks, ngram_join
from larkspur.llm.ngram_join import Join


def numbers(a, b):
    return " ".join(f"n{k}" for k in range(a, b))


def brute_by_set(rows, join):
    """Classes where a row's set, not its id, is what links; equal sets are one."""
    sets = [frozenset(zip(*[w[k:] for k in range(join.words)], strict=False)) if len(w := (t or "").lower().split()) >= join.words else frozenset([tuple(w)] if w else []) for _, t in rows]
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and len(sets[i] & sets[j]) * join.of >= join.share * len(sets[i] | sets[j])]
    roots = closure(range(n), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[roots[i]] = min(d, least.get(roots[i], d))
    return sorted(((d, len(sets[i]), least.get(roots[i], d) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("order", range(4))
def test_an_id_repeated_with_other_texts(spark, order):
    rows = [(1, numbers(1, 58)), (1, numbers(1, 55)), (5, numbers(1, 61)), (1, "something else " + numbers(100, 130)), (7, numbers(100, 130) + " something else"), (None, numbers(1, 58)), (None, numbers(2, 61)), (None, numbers(200, 260)), (None, numbers(200, 261)), (9, None), (9, "")]
    random.Random(order).shuffle(rows)
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1 + order % 2), Join(3, 90, 100))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_by_set(rows, Join(3, 90, 100))


def hot(rng, n=260):
    """Documents that share a passage, near copies among them, and chains of copies of copies: all meet in the same long runs."""
    passage = [f"p{k}" for k in range(40)]
    rows, last = [], passage
    for d in range(n):
        if d % 3 == 0:
            own = passage + [f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(30))]
        elif d % 3 == 1:
            own = list(passage)
            own[rng.randrange(40)] = f"x{d}"
        else:
            last = own = [*last[:-1], f"c{d}"] if d % 2 else [f"c{d}", *last[1:]]
        rows.append((d, " ".join(own)))
    return rows


@pytest.mark.parametrize(("join", "run", "crowd", "block"), [(Join(3, 90, 100), 8, 500_000, 250_000), (Join(3, 80, 100), 8, 3000, 300), (Join(2, 1, 2), 4, 2000, 900), (Join(1, 100, 100), 2, 100, 100)])
def test_long_runs_and_large_classes(spark, monkeypatch, join, run, crowd, block):
    for name, value in (("RUN", run), ("CROWD", crowd), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = hot(random.Random(run))
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), join)
    assert sorted(map(tuple, found.collect())) == brute_classes(rows, join)


@pytest.mark.parametrize("common", [-10**9, 3, 100])
def test_very_common_elements(spark, monkeypatch, common):
    """The classes don't depend on which elements count as very common."""
    monkeypatch.setattr(ngram_join, "HOT", common)
    rows = hot(random.Random(5)) + [(1000 + k, numbers(900 + k, 960 + k)) for k in range(5)] + [(2000, None), (2001, "")]
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Join(3, 90, 100))
    assert sorted(map(tuple, found.collect())) == brute_classes(rows, Join(3, 90, 100))


def test_rows_of_a_common_element_are_spread(spark):
    """An element of 100,000 documents: no task of the exchange has over three times the rows of the median one."""
    rows = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("element"), F.xxhash64("id").alias("sid"), F.lit(50).alias("n"), F.when(F.col("id") % 2 == 0, 0).otherwise(1).alias("need"), F.lit(1).alias("level"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = ngram_join._meet(rows, Join()).withColumn("task", F.spark_partition_id())
        counts = sorted(r["count"] for r in met.groupBy("task").count().collect())
        members = met.where("need < 0 and b = 7").select("a").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert members == 50_000 and len(counts) == 4 and counts[-1] < 3 * counts[1]


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(4)
    for join in (Join(3, 90, 100), Join(3, 4, 5), Join(3, 1, 2)):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, size=rng.integers(1, 60))) for _ in range(20)]
        for s in list(sets):
            for _ in range(6):
                keep = rng.random(len(s)) > 0.12
                sets.append(np.unique(np.append(s[keep], rng.choice(pool, size=rng.integers(0, 4)))))
        sets = [s for s in sets if len(s)]
        may = ngram_join.may_link(join)([len(s).to_bytes(8, "little") + ngram_join.bitmap(s, join).tobytes() for s in sets])
        do = ngram_join.linked(join)([s.tobytes() for s in sets])
        every, unrelated = np.arange(len(sets)), 0
        for x in range(len(sets)):
            links, allowed = do(x, every), may(x, every)
            want = [y for y in every if len(np.intersect1d(sets[x], sets[y])) * join.of >= join.share * len(np.union1d(sets[x], sets[y]))]
            assert links.tolist() == want and set(want) <= set(allowed.tolist())
            unrelated += len(allowed) - len(want)
        assert unrelated < 0.1 * len(sets) ** 2


def test_groups_are_connected_whatever_the_blocks(spark):
    """Numbers link where they differ by 3 or 4; groups of any size, of one cluster and of several."""
    rng = random.Random(2)
    members = [(g, g * 10_000 + k * rng.choice((1, 3, 5))) for g in range(6) for k in range(g * 12)]
    members = sorted(set(members))
    near = lambda payloads: lambda x, others, v=np.array([int(p) for p in payloads]): others[np.isin(np.abs(v[others] - v[x]), (3, 4))]
    table = spark.createDataFrame([(g, n, 1) for g, n in members], "g long, node long, size long")
    load = lambda rows: rows.withColumn("payload", rows["node"].cast("string").cast("binary"))
    want = closure([n for _, n in members], [(a, b) for g, a in members for h, b in members if g == h and b - a in (3, 4)])
    for limit in (1, 3, 10, 10_000):
        links = [tuple(r) for r in blocks.link_groups(table, load, near, limit).collect()]
        assert all(abs(a - b) in (3, 4) for a, b in links) and closure([n for _, n in members], links) == want


def test_long_texts_and_odd_columns(spark):
    long = numbers(0, 60_000)
    rows = [(1, long, 0, "x"), (2, long + " end", 0, "x"), (3, "w" * 300_000, 1, None), (4, "W" * 300_000, 1, None), (6, long.upper(), 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, node string")
    for a, b in (("sid", "bits"), ("payload", "part"), ("component_id", "class")):
        found = ngram_join.classes(docs.withColumnsRenamed({"n": a, "node": b}), Join(3, 90, 100))
        assert sorted(map(tuple, found.collect())) == [(1, 59_998, 1), (2, 59_999, 1), (3, 1, 3), (4, 1, 3), (6, 59_998, 1)]


def test_one_row_of_each_class(spark):
    text = numbers(0, 30)
    rows = [(1, text, "b"), (1, text, "a"), (None, text, "a"), (None, text, "a"), (7, text + " more", "a"), (None, "lone null copies here now", "z"), (None, "lone null copies here now", "z"), (None, "lone null copies here now", "y"), (3, None, "q"), (3, None, "q"), (4, "", "q"), (8, "quite another text of some words", None), (8, "quite another text of some words", None), (8, "and one more under the same id", None)]
    want = sorted([(1, text, "a"), (None, "lone null copies here now", "y"), (3, None, "q"), (3, None, "q"), (4, "", "q"), (8, "quite another text of some words", None), (8, "and one more under the same id", None)], key=repr)
    for seed, names in enumerate((("doc_id", "text", "c"), ("doc_id", "text", "k"), ("doc_id", "text", "n_shingles"))):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, c string").toDF(*names).repartition(1 + seed)
        kept = ngram_join.one_of_each_class(docs)
        assert kept.columns == list(names) and sorted(map(tuple, kept.collect()), key=repr) == want
    assert ngram_join.one_of_each_class(docs.limit(0)).count() == 0


def test_near_copies_leave_one_each(spark):
    rows = near_copies(random.Random(11))
    join = Join(5, 4, 5)
    stay = {d for d, n, c in brute_classes(rows, join) if d == c}
    assert {r["doc_id"] for r in ngram_join.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string"), join).collect()} == stay
