"""Redirect chains and click depths against walking them one by one."""

import random

import pytest

from larkspur.operators import graphs


def walk(redirects):
    """(target, steps, loop) of every address."""
    to = {}
    for s, d in redirects:
        if s is not None and d is not None:
            to[s] = min(d, to.get(s, d))
    out = []
    for s in to:
        path, at = [s], to[s]
        while at in to and at not in path:
            path.append(at)
            at = to[at]
        out.append((s, None, None, min(path[path.index(at) :])) if at in path else (s, at, len(path), None))
    return sorted(out)


def chains(spark, redirects):
    return sorted(map(tuple, graphs.redirect_chains(spark.createDataFrame(redirects, "src long, dst long").repartition(3)).collect()))


@pytest.mark.parametrize("redirects", [
    [(i, i + 1) for i in range(37)],
    [(i, i + 1) for i in range(5)] + [(10, 11), (11, 12), (12, 10), (13, 12), (14, 13), (20, 20), (21, 20)],
    [(1, 2), (2, 1)],
    [(i, 0) for i in range(1, 400)] + [(0, 1000), (500, 7), (7, 3), (7, 900)],
    [(None, 1), (1, None), (2, 3), (2, 3)],
    [],
])
def test_chains(spark, redirects):
    assert chains(spark, redirects) == walk(redirects)


def test_random_redirects(spark):
    rng = random.Random(4)
    redirects = [(i, rng.randrange(252)) for i in range(250)]
    assert chains(spark, redirects) == walk(redirects) and any(r[3] is not None for r in walk(redirects))


def test_addresses_of_text(spark):
    made = spark.createDataFrame([("/a", "/b"), ("/b", "/c"), ("/x", "/y"), ("/y", "/x")], "src string, dst string")
    assert sorted(map(tuple, graphs.redirect_chains(made).collect())) == [("/a", "/c", 2, None), ("/b", "/c", 1, None), ("/x", None, None, "/x"), ("/y", None, None, "/x")]


def test_depths_and_orphans(spark):
    links = [(i, i + 1) for i in range(20)] + [(0, 10), (5, 0), (30, 31), (31, 30), (None, 4), (3, None), (3, 99), (99, 40), (0, 1)]
    pages = [*range(21), 30, 31, 40, 41]
    found = graphs.click_depth(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(p,) for p in pages], "node long"), spark.createDataFrame([(0,), (None,)], "node long"))
    depth = {i: min(i, i - 9) if i >= 10 else i for i in range(21)} | {30: None, 31: None, 40: 5, 41: None}
    assert sorted(map(tuple, found.collect())) == sorted((k, d, d is None) for k, d in depth.items())


def test_without_a_start_all_pages_are_orphans(spark):
    none = spark.createDataFrame([], "node long")
    found = graphs.click_depth(spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(1,), (2,)], "node long"), none)
    assert sorted(map(tuple, found.collect())) == [(1, None, True), (2, None, True)]
