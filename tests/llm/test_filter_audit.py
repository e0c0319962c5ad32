"""The audit against applying the filters one after the other."""

import random
import re
from itertools import permutations

import pytest

from larkspur.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, n long"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return found + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))


def plain(docs, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x, _ in labels if x == 1 and d is not None}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = [(d, lang or "", fails(text or "") + "E" * (d is not None and d > least[text or ""])) for d, text, lang, *_ in docs]
    out = []
    for part in {r[1] for r in rows}:
        own, total, found = [r for r in rows if r[1] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[2]]
                earlier = set(order[: step - 1])
                left = [r for r in left if f not in r[2]]
                total[f] += len(here)
                redundant = sum(f in r[2] and bool(earlier & set(r[2])) for r in own)
                found.append((f, (part, "".join(order), step, len(left), len(here), redundant, sum(r[2] == f for r in own), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here))))
        out += [(*row, total[f]) for f, row in found]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    kinds = [lambda: " ".join(rng.choices(words, k=260)), lambda: " ".join(rng.choices(words[:3], k=300)), lambda: "SHOUT " * 5, lambda: "a & b", lambda: "", lambda: None, lambda: "the hot text\x0b\x0cagain x"]
    return [(rng.choice([i, i, i, i // 2, None]), rng.choice(kinds)(), rng.choice(["en", "de", "", None]), "p", 1) for i in range(n)]


@pytest.mark.parametrize("held", [1, 3_000, 16_000_000])
def test_all_orders(spark, monkeypatch, held):
    """Whatever map tasks hold at once; copies, null and repeated ids and texts included."""
    monkeypatch.setattr(filter_audit, "HELD", held)
    docs = made(300, held) + [(7, "same row", "en", "p", 1)] * 20 + [(2**62 + i, "same row", "fr", "p", 1) for i in range(60)]
    labels = [(i, i % 2, i % 3 == 0, 9) for i in range(0, 300, 2)] + [(4, 1, None, 1), (4, None, 1, 1), (None, 1, 1, 1), (2**62 + 3, 1, 1, 1)]
    labels = [(d, q, None if x is None else int(x), n) for d, q, x, n in labels]
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, found.collect())) == plain(docs, labels)


def test_colliding_fingerprints_keep_their_texts_apart():
    held = filter_audit.Chains(16)
    late = [x for k, t in enumerate(["a", "b", "a", "b", "a"]) for x in held.add(1, t, 10 - k, 3, {"en": 1})]
    assert [(d, m) for d, m, _ in late] == [(10, 19), (9, 19), (8, 19)]
    assert sorted((link[0], link[1]) for _, link in held.close()) == [("a", 6), ("b", 7)]


def test_no_documents_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "w " * 50_000, None, None, None)], DOCS)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and sum(r["removed"] for r in rows) == 120 and sum(r["unique_fails"] for r in rows) == 120


def test_one_text_in_a_third_of_all_rows_is_sent_once_a_piece(spark):
    docs = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"own {i}", "en", "p", 1) for i in range(3_000)], DOCS).repartition(4)
    sent = docs.selectExpr("doc_id", "lang", "text", "xxhash64(text)", "0").rdd.mapPartitions(filter_audit._send(16)).map(lambda x: x[1][0]).collect()
    assert sum(t == "copy" for t in sent) == 4 and sum(t is None for t in sent) == 996 and len(sent) == 3_000
