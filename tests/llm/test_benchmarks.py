"""Decontamination with large and odd benchmarks, and its recall by the length of the items."""

import pickle
import random

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_edits

from larkspur.llm import decontamination
from larkspur.llm.decontamination import Settings


def edited(rng, item, edits, words):
    """An item with that many edits, at random places."""
    own = list(item)
    for _ in range(edits):
        k = rng.randrange(len(own))
        kind = rng.randrange(3)
        if kind == 0:
            own[k] = rng.choice(words)
        elif kind == 1:
            own.insert(k, rng.choice(words))
        elif len(own) > 1:
            del own[k]
    return own


@pytest.mark.parametrize("length", [5, 8, 12, 20, 30, 40, 45, 60, 100, 200])
def test_recall_at_the_most_edits(length):
    """Items with the most edits allowed, inside documents: at least nine of ten are found (and nothing that isn't there)."""
    rng = random.Random(length)
    words = [f"w{k}" for k in range(3000)]
    items = [[rng.choice(words) for _ in range(length)] for _ in range(150)]
    texts = [[rng.choice(words) for _ in range(rng.randrange(30))] + edited(rng, item, int(0.2 * length), words) + [rng.choice(words) for _ in range(rng.randrange(30))] for item in items]
    block = decontamination.Items(list(range(len(items))), [" ".join(x) for x in items], Settings())
    found = {(d, block.ids[i][0]): e for d, i, _, _, e in block.search([" ".join(t) for t in texts])}
    there = {(k, k) for k, (item, text) in enumerate(zip(items, texts, strict=True)) if brute_edits(item, text)[0] <= int(0.2 * length)}
    assert len(there) > 140 and len(there & set(found)) >= 0.9 * len(there)
    assert all(brute_edits(items[i], texts[d])[0] == e for (d, i), e in found.items())


def test_very_many_copies_of_one_item(spark):
    text = "what is the height of the old tower in the middle of the town"
    bench = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(-1, "some other question of a few more words than that")], "item_id long, text string"))
    docs = spark.createDataFrame([(1, f"so {text} now"), (2, "nothing of it"), (None, text)], "doc_id long, text string")
    n, blocks = decontamination._blocks(decontamination._texts(bench, "item_id", "text"), Settings())
    (block,) = blocks
    assert n == 1 and len(block.words) == 2
    found = decontamination.find(docs, bench).groupBy("doc_id").agg(F.count_distinct("item_id").alias("n"), F.max("distance").alias("e")).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, 100_000, 0), (None, 100_000, 0)]
    assert [r["doc_id"] for r in decontamination.remove(docs, bench).collect()] == [2]


def test_a_benchmark_of_many_blocks(spark):
    """What is collected and broadcast at a time stays within the bound; the result is that of one block."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(120)]
    docs = [(d, " ".join([rng.choice(words), *items[rng.randrange(120)][1].split(), rng.choice(words)] if d % 2 else rng.choices(words, k=20)), "c") for d in range(60)] + [(None, None, "c"), (7, "", "c")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string, row string"), spark.createDataFrame(items, "item_id long, text string")
    small = Settings(block_bytes=20_000)
    n, blocks = decontamination._blocks(decontamination._texts(b, "item_id", "text"), small)
    sizes = [len(block.words) for block in blocks]
    assert n >= 8 and len(sizes) == n and min(sizes) > 0 and sum(sizes) == len({tuple(t.split()) for _, t in items})
    one, many = (sorted(map(tuple, decontamination.find(a, b, s).collect())) for s in (Settings(), small))
    assert one == many and len(one) >= 25
    left, kept = (sorted(map(tuple, decontamination.remove(a, b, s).collect()), key=repr) for s in (Settings(), small))
    assert left == kept and decontamination.remove(a, b, small).columns == a.columns
    assert {r[0] for r in kept if r[0] is not None} == {d for d, _, _ in docs if d is not None} - ({r[0] for r in one} - {7}) or 7 in {r[0] for r in one}


def test_the_first_of_equal_places_and_clashing_columns(spark):
    item = "one two three four five six"
    docs = spark.createDataFrame([(1, f"x {item} y {item} z", 9, 0.5, "h")], "doc_id long, text string, item_id long, similarity double, h string")
    bench = spark.createDataFrame([(4, item, 1, "d")], "item_id long, text string, doc_id long, t string")
    (row,) = decontamination.find(docs, bench).collect()
    assert tuple(row) == (1, 4, 1, 7, 0, 1.0)
    bench = bench.unionByName(bench.withColumns({"item_id": F.lit(5), "text": F.lit("of another block")}))
    for size in (16_000_000, 10):
        assert decontamination.remove(docs, bench, Settings(block_bytes=size)).count() == 0
        assert tuple(decontamination.remove(docs, bench.withColumn("text", F.lit("not in there at all")), Settings(block_bytes=size)).first()) == tuple(docs.first())


def test_very_long_texts(spark):
    """An edited item at the end of a text of a million words, and an item of thousands of words."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    item = [rng.choice(words) for _ in range(20)]
    long_item = [rng.choice(words) for _ in range(3000)]
    filler = " ".join(rng.choice(["and", "then", "some", "more"]) for _ in range(1_000_000))
    docs = spark.createDataFrame([(1, f"{filler} {' '.join(edited(rng, item, 4, words))}"), (2, f"{filler[:9000]} {' '.join(edited(rng, long_item, 400, words))}"), (3, filler)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long_item))], "item_id long, text string")
    found = decontamination.find(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("length", [(5, 5), (1, 4), (10, 60), (200, 400)])
def test_blocks_are_bounded_by_what_is_sent(spark, length):
    """Blocks are as large as the bound says when they are pickled, but for their fixed parts, and fill half of it at least."""
    rng = random.Random(sum(length))
    words = [f"word{k}" for k in range(30_000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(*length)))) for k in range(4000 if length[1] < 100 else 200)]
    bound = 1_500_000
    n, blocks = decontamination._blocks(decontamination._texts(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"), Settings(block_bytes=bound))
    sizes = [len(pickle.dumps(block, protocol=5)) for block in blocks]
    assert n == len(sizes) >= 2 and max(sizes) < bound + 50_000
    assert sum(sizes) > bound * (n - 1) * (0.5 if length[0] > 4 else 0.05)


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.75, 1.0])
def test_short_items_at_other_similarities(spark, similarity):
    """Items of fewer than five words equal brute force, edits included, whatever is allowed; longer ones are real and mostly found."""
    rng = random.Random(int(similarity * 100))
    words = [f"w{k}" for k in range(60)]
    items = {k: rng.choices(words, k=rng.randint(1, 4)) for k in range(40)} | {k: rng.choices(words, k=8) for k in range(40, 50)}
    docs = {d: [*rng.choices(words, k=rng.randrange(12)), *edited(rng, items[rng.randrange(50)], rng.randrange(3), words), *rng.choices(words, k=rng.randrange(12))] for d in range(80)} | {80: []}
    found = decontamination.find(spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string"), Settings(similarity=similarity))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    want = {(d, k): e for d, t in docs.items() for k, item in items.items() if t and (e := brute_edits(item, t)[0]) <= int((1 - similarity) * len(item) + 1e-9)}
    assert {x: e for x, e in got.items() if x[1] < 40} == {x: e for x, e in want.items() if x[1] < 40}
    assert got.items() <= want.items() and len(want) > 40


def test_one_edit_in_a_short_item():
    items = decontamination.Items([1], ["alpha beta gamma delta"], Settings(similarity=0.7))
    assert items.search(["none", "x alpha beta gamma zeta y"]) == [(1, 0, 1, 4, 1)]
    with pytest.raises(ValueError, match="similarity"):
        decontamination.Items([1], ["a"], Settings(similarity=0))
