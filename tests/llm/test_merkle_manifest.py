"""Trees, proofs and their checks against plain recursion."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import merkle_manifest as mm
from larkspur.llm.workspace import Stash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in mm.FIELDS])


def plain_tree(nodes, fanout):
    """The root, and for each node (siblings of each level)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    proofs = []
    for i in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            start = i // fanout * fanout
            proof += [x for j, x in enumerate(level[start : start + fanout], start) if j != i]
            i //= fanout
        proofs.append(proof)
    return levels[-1][0], proofs


def plain(rows, fanout):
    """(id, leaf, subroot, root, siblings) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        leaves = [plain_leaf(r) for r in own]
        subroot, proofs = plain_tree(leaves, fanout)
        subroots.append(subroot)
        found.append((own, leaves, subroot, proofs))
    root, upper = plain_tree(subroots, fanout)
    return [(r["doc_id"], x, subroot, root, "".join(p + up)) for (own, leaves, subroot, proofs), up in zip(found, upper, strict=True) for r, x, p in zip(own, leaves, proofs, strict=True)]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def made(n, sources, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["", "a\nb", "é ß\n", None, "x" * 50_000 if i % 50 == 0 else "x"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, i]), "t", "d", "p") for i in range(n)]


@pytest.mark.parametrize(("n", "sources", "fanout", "levels"), [(1, [None], 3, 2), (2, ["a", None], 3, 2), (95, ["a", "b", "", None, "é", "a/b"], 3, 1), (163, ["a"], 3, 2), (120, ["hot", "hot", "hot", "x", "y"], 2, 3), (60, [f"s{i}" for i in range(40)], 3, 2), (82, ["a"], 9, 1)])
def test_trees_and_proofs(spark, n, sources, fanout, levels):
    docs = rows_of(spark, made(n, sources, n))
    found = mm.verified(mm.manifest(docs, fanout=fanout, levels=levels))
    rows = found.collect()
    got = [(r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["siblings"].hex()) for r in rows]
    assert sorted(got) == sorted(plain(docs.collect(), fanout))
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "same", "en", "a", 4, None, None, None)] * 40 + [(None, "x", None, "a", None, None, None, None)] * 3 + [(7, "other", "en", "a", 4, None, None, None), (2**62 + 1, "big", "en", "a", 4, None, None, None)]
    docs = rows_of(spark, rows)
    got = [(r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), r["siblings"].hex()) for r in mm.manifest(docs, levels=2).collect()]
    assert sorted(got, key=repr) == sorted(plain(docs.collect(), 3), key=repr)


def test_no_rows(spark):
    assert mm.verified(mm.manifest(rows_of(spark, []))).collect() == []


def test_a_change_fails_its_own_proof_alone(spark):
    docs = rows_of(spark, made(50, ["a", "b"], 3))
    shown = mm.leaf([F.col(c) if c != "text" else F.when(F.col("doc_id") == 13, "changed").otherwise(F.col("text")) for c in mm.FIELDS])
    found = mm.verified(mm.manifest(docs, carry={"shown": shown}), "shown").collect()
    assert [r["doc_id"] for r in found if not r["verified"]] == [13]


def test_the_fields_of_a_leaf_cannot_run_into_each_other(spark):
    rows = [(1, "ab", "c", "s", None, None, None, None), (1, "b", "ca", "s", None, None, None, None), (1, None, "-", "s", None, None, None, None), (1, "-", None, "s", None, None, None, None)]
    assert len({r[0] for r in rows_of(spark, rows).select(mm.leaf([F.col(c) for c in mm.FIELDS])).collect()}) == 4


def test_numbers_are_gapless_however_ranges_are_cut(spark):
    stash = Stash(spark)
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("tree"), (F.col("id") % 11).alias("k"), F.col("id").alias("r"))
    numbered = mm._numbered(stash.save(rows, "rows")[0], ["k", "r"], stash).collect()
    by = {}
    for r in sorted(numbered, key=lambda r: (r["tree"], r["k"], r["r"])):
        by.setdefault(r["tree"], []).append((r["idx"], r["n"]))
    assert all(x == [(i, len(x)) for i in range(len(x))] for x in by.values()) and len(numbered) == 5000
