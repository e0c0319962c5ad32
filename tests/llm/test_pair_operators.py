"""WARC, sharding, near duplicates: against brute force and round trips."""

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, embedding_dedup, filters, ngram_join, sharding, warc


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- components -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [40, 500_000])
def test_components(spark, monkeypatch, piece):
    monkeypatch.setattr(components, "PIECE", piece)
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    rng.shuffle(links)
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(6))
    real = [(a, b) for a, b in links if a is not None]
    want = {n: r for n, r in closure({n for x in real for n in x}, real).items() if n != r}
    assert {r["node"]: r["root"] for r in found.collect()} == want and found.count() == len(want)


def test_no_links_no_components(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_loses_nothing(spark):
    ids = spark.range(0, 3000, 3)
    known = filters.build(ids, "id")
    rows = spark.range(0, 3000).where(known("id"))
    assert rows.join(ids, "id").count() == 1000 and rows.count() < 1100
    assert spark.createDataFrame([(None,)], "id long").where(known("id")).count() == 0


# -- 3 --------------------------------------------------------------------------------------------------------

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [(5, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (9, None, BIG), (3, "http://c/", "small"), (4, "http://d/", "small"), (6, "http://e/", None), (7, "u", "é" * 100), (8, "u", "WARC/1.1\r\n\r\n" * 30), (None, "n", BIG), (2, "http://b/", BIG)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, url string, html string, payload string").repartition(3)


def test_archive_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write(warc.archive(pages), path, max_file_bytes="600")
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r["record_id"], r["record_type"], None if r["payload"] is None else bytes(r["payload"]), r["refers_to"]) for r in rows), key=repr)
    want = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        revisit = html == BIG and key != 2
        want.append((f"urn:page:{'' if key is None else key}", "revisit" if revisit else "response", b"" if revisit else body, "urn:page:2" if revisit else None))
    assert got == sorted(want, key=repr)
    for r in rows:
        assert r["payload_digest"].startswith("sha256:") and "\r" not in (r["target_uri"] or "")
        if r["record_type"] == "response":
            assert r["payload_digest"] == "sha256:" + hashlib.sha256(bytes(r["payload"])).hexdigest()
    assert next(r for r in rows if r["record_id"] == "urn:page:9")["http_headers"]["content-length"] == str(len(BIG))


def test_filters_reach_the_reader(spark, pages, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write(warc.archive(pages), path)
    found = warc.read(spark, path, payload=False).where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http"))
    assert {r["record_id"] for r in found.collect()} == {"urn:page:5"} and found.where("payload is not null and length(payload) > 0").count() == 0
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("path",), "x")]))
    assert len(left) == 1 and reader.wanted.equal == {"record_type": {"response"}}


def test_foreign_archives(spark, tmp_path):
    """Plain files, and gzip members without the length field, with folded headers and other record types."""
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + warc.record("urn:page:1", "response", "2024-01-01T00:00:00Z", "http://a/", "0", 3, b"abc", None)
    (tmp_path / "a.warc").write_bytes(plain)
    one, two = plain[: plain.index(b"hello") + 9], plain[plain.index(b"hello") + 9 :]
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two.replace(b"WARC-Date: ", b"WARC-Date:\r\n ")))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r["record_type"], bytes(r["payload"])) for r in rows) == [("response", b"abc")] * 2 + [("warcinfo", b"hello")] * 2
    assert warc.read(spark, f"file://{tmp_path}", payload=False).where("record_type = 'response'").count() == 2


def test_members_are_gzip():
    assert gzip.decompress(warc.member(b"abc" * 100) + warc.member(b"")) == b"abc" * 100


def test_no_pages(spark, pages, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(warc.archive(pages.limit(0)), path)
    assert warc.read(spark, path).count() == 0


# -- 8 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 4097])
def test_feistel_permutes(n):
    f = sharding.Feistel(n, 5)
    p = f.permute(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and (f.invert(p) == np.arange(n)).all()
    shard, slot = f.place(n - 1, 24)
    assert f.row(shard, slot, 24) == n - 1


def test_shards(spark):
    import zlib

    rows = [(k * 7 % 1000, f"text {k % 50}") for k in range(1000)] + [(None, None), (None, "x"), (None, "x"), (3, "é"), (3, "é"), (3, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string")
    found = sharding.shard(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # The place of a row follows from its number in the order of (id, checksum, size), nulls first.
    order = sorted(((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t in rows))
    feistel = sharding.Feistel(len(rows), 1729)
    want = sorted((d if known else None, c, *feistel.place(k, 24)) for k, (known, d, c, _) in enumerate(order) if known)
    assert sorted((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in found if r["doc_id"] is not None) == want
    again = sharding.shard(docs.repartition(2)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


def test_no_rows_no_shards(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- 9 --------------------------------------------------------------------------------------------------------


def brute_classes(rows, join):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = set() if not w else {tuple(w)} if len(w) < join.words else set(zip(*[w[k:] for k in range(join.words)], strict=False))
    links = []
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and both and both * join.of >= join.share * len(sets[a] | sets[b]):
                links.append((a, b))
    roots = closure(ids, links)
    return sorted((d, len(sets[d]), roots[d]) for d, _ in rows)


def near_copies(rng, n=150):
    words = [f"v{k}" for k in range(60)]
    rows, bases = [], [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    for d in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(own))
            own[k] = rng.choice(words)
        rows.append((d, " ".join(own)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE two"), (n + 4, "one"), (n + 5, " \t\n")]


@pytest.mark.parametrize(("join", "run", "block"), [(ngram_join.Join(3, 90, 100), 64, 250_000), (ngram_join.Join(5, 4, 5), 64, 250_000), (ngram_join.Join(2, 1, 2), 3, 200), (ngram_join.Join(3, 7, 10), 1, 60)])
def test_classes_equal_brute_force(spark, monkeypatch, join, run, block):
    """Small runs and blocks send everything by the ways for hot elements and large components."""
    rows = near_copies(random.Random(run + join.words))
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    found = ngram_join.classes(spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, sid string").repartition(5), join)
    assert sorted(map(tuple, found.collect())) == brute_classes(rows, join)


def test_class_edges(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(1, text), (1, text), (5, text), (None, text), (None, "something else entirely here now"), (3, None)]
    found = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Join())
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 12, 1), (1, 12, 1), (5, 12, 1), (None, 12, 1), (None, 1, None), (3, 0, 3)], key=repr)
    assert ngram_join.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- 7 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("run", "block"), [(512, 2000), (20, 30)])
def test_vectors_equal_brute_force(spark, monkeypatch, run, block):
    monkeypatch.setattr(embedding_dedup, "RUN", run)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    made = list(base)
    for k in range(120):
        e = rng.standard_normal(32)
        made.append((base[k % 10] + e / np.linalg.norm(e) * rng.uniform(0.05, 0.33)) * rng.uniform(0.1, 9))
    made += [base[30] + rng.standard_normal(32) * 0.005 for _ in range(70)] + [made[3]] * 4
    rows = [(k, np.asarray(v, dtype="float32").tolist(), k) for k, v in enumerate(made)]
    n = len(rows)
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [], [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + k, v, None) for k, v in enumerate(odd)]
    found = {r["vec_id"]: tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)).collect()}
    x = np.array([np.asarray(v, dtype="float32").astype(float) for _, v, _ in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    roots = closure(range(n), zip(*np.nonzero(near), strict=True))
    for k in range(n):
        assert found[k] == (k, near[k].sum(), roots[k], roots[k] == k)
    for k in range(n, n + 6):
        assert found[k] == (k, 0, k, True)
    assert found[n + 7] == (n + 7, 1, n + 6, False)


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_plan_grows_slowly():
    assert embedding_dedup.plan(10_000, 0.95, 0.999)[1] < embedding_dedup.plan(10_000_000, 0.95, 0.999)[1] < 10 * embedding_dedup.plan(10_000, 0.95, 0.999)[1]
