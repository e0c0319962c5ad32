"""Sets that share some n-grams and little else are no candidates, however many documents share those."""

import random

import numpy as np
import pytest
from test_pair_operators import brute_classes

from larkspur.llm import ngram_join
from larkspur.llm.ngram_join import Join


@pytest.mark.parametrize(("docs", "words"), [(50, 4), (1500, 8)])
def test_candidates_are_few(spark, monkeypatch, docs, words):
    """Texts of a few words by chance: of 50 any two share n-grams in short runs, of 1,500 all meet in long ones. Only the near copies may link."""
    rng = random.Random(words)
    rows = [(d, " ".join(f"w{rng.randrange(words)}" for _ in range(40))) for d in range(docs)]
    rows += [(docs + d, f"{t} end") for d, t in rows[:7]]
    found, whole = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links, *ends: found.append({tuple(sorted(r)) for r in links.collect()}) or whole(links, *ends))
    classes = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Join(3, 90, 100))
    assert sorted(map(tuple, classes.collect())) == brute_classes(rows, Join(3, 90, 100))
    assert len(found) == 2 and len(found[0]) < 14 and len(found[1]) >= 7  # candidates, links


def test_pairs_are_judged_like_groups():
    join, rng = Join(3, 90, 100), np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 90, 150, 170, 1000)]
    sets += [s[: max(1, int(len(s) * k))] for s in sets for k in (0.85, 0.91, 0.97)]
    own = [len(s).to_bytes(8, "little") + ngram_join.bitmap(s, join).tobytes() for s in sets]
    x, y = (a.ravel() for a in np.indices((len(own), len(own))))
    want = [len(ngram_join.may_link(join)([own[i], own[j]])(0, np.array([1]))) == 1 for i, j in zip(x, y, strict=True)]
    assert ngram_join.may_link_pairs([own[i] for i in x], [own[j] for j in y], join).tolist() == want
    assert ngram_join.may_link_pairs([], [], join).tolist() == []


def test_rare_words_make_rare_ngrams_whatever_the_noise():
    """A full sketch of n-grams tells nothing of these two; the words do."""
    hashes = np.arange(4, dtype=np.uint64) << np.uint64(50)
    words = np.full(ngram_join.COUNTERS, 3, dtype=np.uint32)
    words[ngram_join.counter(hashes[:3])] = 50_000_000
    grams = np.random.default_rng(1).poisson(5000, ngram_join.COUNTERS).astype(np.uint32)
    counts = ngram_join.Counts(grams, words)
    own = np.array([7, 8], dtype=np.uint64) << np.uint64(45)
    grams[ngram_join.counter(own)] = 5050, 5100
    held, common = counts.look(hashes, 3, own, np.array([0, 1]))
    assert held[0] > 1e6 and held[1] < 1 and not common.any()
