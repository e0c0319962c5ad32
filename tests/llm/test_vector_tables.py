"""The bound on hash tables costs no recall."""

import numpy as np
import pytest

from larkspur.llm import embedding_dedup


@pytest.mark.parametrize(("n", "threshold"), [(10**8, 0.9), (10**6, 0.8), (10**9, 0.5), (10**6, 0.0)])
def test_the_bound_on_tables_keeps_the_recall(n, threshold):
    projections, tables = embedding_dedup.plan(n, threshold, 0.999)
    same = embedding_dedup._same_cell(np.sqrt(2 - 2 * threshold)) ** projections
    assert 1 - (1 - same) ** tables >= 0.999 and tables <= embedding_dedup.MOST_TABLES


@pytest.mark.parametrize("n", [1_000, 50_000, 10**7, 10**10])
def test_a_vector_meets_few_unrelated_ones_in_a_table(n):
    projections, _ = embedding_dedup.plan(n, 0.95, 0.999)
    apart = embedding_dedup._same_cell(np.sqrt(2))
    assert n * apart**projections <= embedding_dedup.MATES
    assert projections == 4 or n * apart ** (projections - 1) > embedding_dedup.MATES  # no more tables than that takes


def test_pairs_are_found_under_the_bound(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_TABLES", 12)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((150, 32))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    made = np.concatenate([base, 0.82 * base + np.sqrt(1 - 0.82**2) * side])
    near = made @ made.T >= 0.8
    np.fill_diagonal(near, False)
    found = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], "vec_id long, embedding array<double>"), threshold=0.8)
    assert {r["vec_id"]: r["n_links"] for r in found.collect()} == dict(enumerate(near.sum(axis=1).tolist()))


def test_tables_stay_few():
    """Every table is a row of each vector in the exchange."""
    assert [embedding_dedup.plan(n, 0.95, 0.999)[1] for n in (51_282, 10**6, 10**9)] == [17, 32, 131]


@pytest.mark.parametrize("held", [1, 700, 10**6])
def test_runs_compare_alike_in_any_strips(monkeypatch, held):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3, 90, 16)) * 0.2 + rng.standard_normal((3, 1, 16))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    small, error = embedding_dedup.unpacked(embedding_dedup.packed(x.reshape(-1, 16)))
    monkeypatch.setattr(embedding_dedup, "HELD", held)
    near = embedding_dedup._may_link(small.reshape(3, 90, 16), error.reshape(3, 90, 1), 0.95)
    must = x @ x.transpose(0, 2, 1) >= 0.95
    must[:, np.arange(90), np.arange(90)] = False
    assert must.any() and not (must & ~near).any() and (near == near.transpose(0, 2, 1)).all()
    assert not (near & (x @ x.transpose(0, 2, 1) < 0.9)).any()
