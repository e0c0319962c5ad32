"""Near-duplicate vectors beyond plain tables: repeated and null ids, long runs, odd columns, and the recall at scale."""

import random

import numpy as np
import pytest
from test_pair_operators import closure

from larkspur.llm import blocks, embedding_dedup

SCHEMA = "vec_id long, embedding array<double>"


def turn(degrees, dim=8):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))] + [0.0] * (dim - 2)


def brute(rows, threshold):
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    equal = (x[:, None, :] == x[None, :, :]).all(axis=2) if len(rows) < 600 else np.zeros_like(near)
    np.fill_diagonal(equal, False)
    near |= equal
    roots = closure(range(len(rows)), zip(*np.nonzero(near), strict=True))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[roots[k]] = min(d, least.get(roots[k], d))
    return sorted(((d, int(near[k].sum()), c := least.get(roots[k]), d == c) for k, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("order", range(3))
def test_ids_repeated_with_other_vectors(spark, order):
    rows = [(1, turn(0)), (1, turn(30)), (5, turn(10)), (5, turn(100)), (1, turn(0)), (None, turn(105)), (None, turn(200)), (None, turn(203)), (8, turn(31))]
    random.Random(order).shuffle(rows)
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1 + order))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 0.95)


@pytest.mark.parametrize(("run", "block", "crowd"), [(128, 2000, 1000), (4, 40, 12)])
def test_long_runs_and_large_classes(spark, monkeypatch, run, block, crowd):
    """A crowd of near copies, a chain of neighbours, and vectors of other lengths among them."""
    for name, value in (("RUN", run), ("BLOCK", block), ("LEAST_BLOCK", 10), ("CROWD", crowd)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(run)
    base = rng.standard_normal(16)
    rows = [(k, (base + rng.standard_normal(16) * 0.02).tolist()) for k in range(200)] + [(200 + k, turn(5 * k, 16)) for k in range(60)] + [(300 + k, rng.standard_normal(16).tolist()) for k in range(60)]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 0.95)


def test_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(1)
    long = rng.standard_normal(20_000).tolist()
    rows = [(1, long, 7, 8), (2, [x * 2 for x in long], 7, 8), (3, [-x for x in long], 7, 8), (4, [1.0], 7, 8), (6, [3.0], 7, 8)]
    for names in (("node", "rep"), ("n_links", "component_id"), ("payload", "number")):
        docs = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {names[0]} int, {names[1]} int")
        found = sorted(map(tuple, embedding_dedup.near_duplicates(docs).collect()))
        assert found == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (6, 1, 4, False)]


def test_the_error_bound_holds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24)) * rng.uniform(0.1, 4, (300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.standard_normal((300, 24)) * 0.06
    x = np.concatenate([x, y / np.linalg.norm(y, axis=1, keepdims=True)])
    payloads = [r.tobytes() for r in embedding_dedup.packed(x)]
    compare = embedding_dedup.may_link(0.95)(payloads)
    for v in range(0, 600, 7):
        assert set(np.flatnonzero(x @ x[v] >= 0.95)) <= set(compare(v, np.arange(600)).tolist())


def test_recall_of_ten_thousand_vectors(spark):
    """Pairs just above the threshold, each pair its own class, so that nothing but its own bucket can find it."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((5000, 48))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * side])
    near = np.zeros(len(x), dtype=np.int64)
    for a in range(0, len(x), 1000):
        near[a : a + 1000] = (x[a : a + 1000] @ x.T >= 0.95).sum(axis=1) - 1
    found = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], SCHEMA).repartition(4)).collect()
    links = {r["vec_id"]: r["n_links"] for r in found}
    assert all(links[k] <= near[k] for k in range(len(x))) and sum(links.values()) >= 0.995 * near.sum() and near.sum() >= 10_000


def test_forest_joins_what_links_join():
    rng = random.Random(5)
    for n in (0, 1, 7, 40):
        linked = np.zeros((n, n), dtype=bool)
        for _ in range(n):
            a, b = rng.randrange(n), rng.randrange(n)
            linked[a, b] = linked[b, a] = a != b
        found = blocks.forest(lambda v, others, m=linked: others[m[v, others]], n)
        assert all(linked[a, b] for a, b in found) and closure(range(n), found) == closure(range(n), zip(*np.nonzero(linked), strict=True))
