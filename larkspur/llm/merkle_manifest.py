"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for every row.

H is SHA-256 of the concatenated inputs, digests as lowercase hex. A leaf is H of the row's fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value. In a group, leaves ascend by id; while more than one node remains, every ``fanout`` consecutive
ones (the last run: fewer, even one) become their H. What remains is the group's subroot; subroots, ordered by group (null
first, then by bytes), give the root the same way.

Superblock reduction: nodes are bucketed by ``index // fanout ** levels``; ``applyInPandas`` collapses ``levels`` levels of a bucket at
once (the topmost round: as many as are left), bucket roots are the nodes of the next round. On the way down each bucket
meets the proof of its own root (a cogroup), and a node's proof is what lies below its bucket's root followed by that.
So neither a tree nor a group is ever in one task, however large: a task holds a bucket (2,187 nodes by default).

Numbering is distributed too: slim rows (no texts) are written out, sorted by ranges and numbered within their range; what comes
before a range is a running total over one row for each range and group. Rows that agree in group, id and leaf are told apart by a
row number, so that even a third of all rows with one id are spread over ranges; which of them is first makes no difference.
Tables of each round are written to the shared folder, rounds are as many as the logarithm asks for (four for 10^10 rows).

A proof has two fields. ``siblings``: the raw digests (32 bytes each) of each run's other nodes, left to right, level by
level up to the root. ``path``: two bytes a level, the place of the node in its run and the run's length. A lone leaf has an
empty proof and is its own subroot. Null ids come first; repeated ids and rows are leaves each; fields are taken by name, other
columns aren't read. An empty table has an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.workspace import Stash

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, idx long, n long, digest binary"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def combine(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _levels(nodes: list[bytes], fanout: int, levels: int) -> list[list[bytes]]:
    """A bucket's nodes, level by level, up to its root."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([combine(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return found


def _with_proofs(levels: list[list[bytes]], fanout: int, path: bytes, siblings: bytes) -> tuple[list[bytes], list[bytes]]:
    """Paths and siblings of a bucket's nodes, given those of its root."""
    paths, others = [path], [siblings]
    for nodes in levels[-2::-1]:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        at = [(i, j) for i, run in enumerate(runs) for j in range(len(run))]
        paths = [bytes((j, len(runs[i]))) + paths[i] for i, j in at]
        others = [b"".join(runs[i][:j] + runs[i][j + 1 :]) + others[i] for i, j in at]
    return paths, others


def _to_collapse(n: int, fanout: int, levels: int) -> int:
    """Levels of a bucket in a tree of ``n`` nodes: all, or in the topmost round those that are left."""
    return levels if n > fanout**levels else height(n, fanout)


class Trees:
    """Reduces numbered nodes (tree, idx, n, digest) of any number of trees to their roots, and brings proofs back down."""

    def __init__(self, stash: Stash, fanout: int, levels: int):
        self.stash, self.fanout, self.levels, self.block = stash, fanout, levels, fanout**levels

    def bucket(self) -> Column:
        return F.expr(f"idx div {self.block}").alias("bucket")

    def up(self, nodes: DataFrame) -> list[DataFrame]:
        """The nodes of each round; those with n = 1 after the first are their trees' roots. Trees that are done leave."""
        fanout, depth, block = self.fanout, self.levels, self.block

        def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own = rows.sort_values("idx")
            n = int(own["n"].iloc[0])
            top = _levels(own["digest"].tolist(), fanout, _to_collapse(n, fanout, depth))[-1][0]
            return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // block)], "digest": [top]})

        rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
        while len(rounds) == 1 or most > 1:
            slim = rounds[-1].select("tree", "idx", "n", "digest")
            slim = slim if len(rounds) == 1 else slim.where("n > 1")
            rounds.append(self.stash.save(slim.groupBy("tree", self.bucket()).applyInPandas(reduce, _NODE), "nodes")[0])
            most = -(-most // block)
        return rounds

    @staticmethod
    def roots(rounds: list[DataFrame]) -> DataFrame:
        """``tree`` and ``digest`` of every root."""
        done = [r.where("n = 1").select("tree", "digest") for r in rounds[1:]]
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        return found

    def down(self, rounds: list[DataFrame], above: DataFrame, carried: str, kept: str) -> DataFrame:
        """Proofs of the first round's nodes. ``above`` has path, siblings and what is ``kept`` (columns and types) for each tree's root."""
        fanout, depth = self.fanout, self.levels
        names = [c.split(" ")[0] for c in kept.split(", ")]

        def emit(carry: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
            def run(own: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
                own, up = own.sort_values("idx"), parent.iloc[0]
                levels = _levels(own["digest"].tolist(), fanout, _to_collapse(int(own["n"].iloc[0]), fanout, depth))
                paths, siblings = _with_proofs(levels, fanout, up["path"], up["siblings"])
                return pd.DataFrame({c: own[c].tolist() for c in ("tree", "idx", *carry)} | {"path": paths, "siblings": siblings} | {c: [up[c]] * len(own) for c in names})

            return run

        proofs: DataFrame | None = None
        for k in range(len(rounds) - 2, -1, -1):
            nodes = rounds[k] if k == 0 else rounds[k].where("n > 1")
            done = rounds[k + 1].where("n = 1").select("tree").join(above, "tree").withColumn("idx", F.lit(0).cast("long"))
            parents = done if proofs is None else done.unionByName(proofs)
            carry = carried + ", " if k == 0 else ""
            pairs = nodes.groupBy("tree", self.bucket()).cogroup(parents.withColumnRenamed("idx", "bucket").groupBy("tree", "bucket"))
            names_carried = [c.split(" ")[0] for c in carry.split(", ") if c]
            found = pairs.applyInPandas(emit(names_carried), f"tree string, idx long, {carry}path binary, siblings binary, {kept}")
            proofs = found if k == 0 else self.stash.save(found, "proofs")[0]
        return proofs


def _numbered(rows: DataFrame, order: list[str], stash: Stash) -> DataFrame:
    """``rows`` with ``idx`` (gapless from 0 in each ``tree``, by ``order``) and ``n``, the tree's rows. ``rows`` must be a written table."""
    keys = ["tree", *order]
    sorted_, _ = stash.save(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sorted_ = sorted_.withColumn("_range", F.shiftright("_at", 33))
    runs = sorted_.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select("tree", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n"))
    return sorted_.join(offsets, ["tree", "_range"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "source", fanout: int = 3, levels: int = 7, carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root`` and the proof (``path``, ``siblings``) of every row; digests are 32 bytes.

    ``carry``: further binary columns of the input that go along, such as the leaf of a row as it was handed over."""
    stash = Stash(docs.sparkSession)
    more = carry or {}
    rows = docs.select(
        F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string"))).alias("tree"),  # null first
        F.col(doc_id).alias("doc_id"),
        leaf([F.col(c) for c in fields]).alias("digest"),
        *[c.alias(name) for name, c in more.items()],
        F.monotonically_increasing_id().alias("_row"),
    )
    slim, slim_path = stash.save(rows, "leaves")
    named = _numbered(slim, ["doc_id", "digest", "_row"], stash).drop("_row").withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null integers
    leaves, _ = stash.save(named, "numbered")
    stash.drop(slim_path)
    trees = Trees(stash, fanout, levels)
    rounds = trees.up(leaves)
    subroots, _ = stash.save(Trees.roots(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), "subroots")
    tops = stash.save(_numbered(subroots, ["own"], stash), "tops")[0]
    upper = trees.up(tops)
    top = Trees.roots(upper).select("tree", F.lit(b"").alias("path"), F.lit(b"").alias("siblings"), F.col("digest").alias("root"))
    proved = trees.down(upper, top, "own string, digest binary", "root binary")
    above, _ = stash.save(proved.select(F.col("own").alias("tree"), "path", "siblings", F.col("digest").alias("subroot"), "root"), "above")
    carried = ", ".join(["doc_id string", "digest binary", *[f"{c} binary" for c in more]])
    found = trees.down(rounds, above, carried, "subroot binary, root binary")
    return found.select(F.col("doc_id").cast(docs.schema[doc_id].dataType), F.col("digest").alias("leaf"), "subroot", "root", "path", "siblings", *more)


def fold(first: bytes, path: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and a proof lead to."""
    node, at = first, 0
    for k in range(0, len(path), 2):
        place, size = path[k], path[k + 1]
        run = [siblings[at + 32 * i : at + 32 * i + 32] for i in range(size - 1)]
        node, at = combine([*run[:place], node, *run[place:]]), at + 32 * (size - 1)
    return node


def verified(proved: DataFrame, shown: str = "leaf") -> DataFrame:
    """``proved`` with ``folded_root`` (where the leaf in column ``shown`` and the proof lead) and ``verified`` (whether that is the root)."""
    schema = proved.drop("folded_root", "verified").withColumn("folded_root", F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (shown, "path", "siblings"))
            roots = [fold(*x) for x in zip(*inputs, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "folded_root"])

    return proved.drop("folded_root", "verified").mapInArrow(run, schema.schema).withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL for the query op11.
SQL = r"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM documents),
even AS (SELECT doc_id, xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for ch in string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) % 2 = 0 AS even FROM documents),
b AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, replace(text, chr(10), '') AS bare, head, text FROM d),
c AS (SELECT doc_id, tree, leaf, sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS cut FROM b),
l AS (SELECT doc_id, tree, leaf, cut, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM c),
up AS (SELECT 0 AS lvl, tree, idx, n, leaf AS digest FROM l
  UNION ALL SELECT lvl + 1, tree, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lvl, tree, idx // 3, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
su AS (SELECT 0 AS lvl, idx, n, subroot AS digest FROM s
  UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM su WHERE n > 1 GROUP BY lvl, idx // 3, n),
r AS (SELECT digest AS root FROM su WHERE n = 1),
h AS (SELECT unnest(range(0, 30)) AS lvl),
p1 AS (SELECT l.doc_id, string_agg(u.digest, '' ORDER BY u.lvl, u.idx) AS proof FROM l, h, up u
  WHERE u.tree = l.tree AND u.lvl = h.lvl AND u.n > 1 AND u.idx // 3 = l.idx // CAST(pow(3, h.lvl + 1) AS BIGINT) AND u.idx <> l.idx // CAST(pow(3, h.lvl) AS BIGINT) GROUP BY l.doc_id),
p2 AS (SELECT s.tree, string_agg(u.digest, '' ORDER BY u.lvl, u.idx) AS proof FROM s, h, su u
  WHERE u.lvl = h.lvl AND u.n > 1 AND u.idx // 3 = s.idx // CAST(pow(3, h.lvl + 1) AS BIGINT) AND u.idx <> s.idx // CAST(pow(3, h.lvl) AS BIGINT) GROUP BY s.tree),
e AS (SELECT 0 AS lvl, l.doc_id, l.tree, l.idx, l.n, CASE WHEN even THEN cut ELSE leaf END AS digest FROM l JOIN even USING (doc_id)),
f1 AS (SELECT * FROM e
  UNION ALL SELECT f.lvl + 1, f.doc_id, f.tree, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.digest ELSE u.digest END, '' ORDER BY u.idx))
  FROM f1 f JOIN up u ON u.lvl = f.lvl AND u.tree = f.tree AND u.idx // 3 = f.idx // 3 WHERE f.n > 1 GROUP BY f.lvl, f.doc_id, f.tree, f.idx // 3, f.n),
g AS (SELECT 0 AS lvl, f1.doc_id, s.idx, s.n, f1.digest FROM f1 JOIN s USING (tree) WHERE f1.n = 1),
f2 AS (SELECT * FROM g
  UNION ALL SELECT f.lvl + 1, f.doc_id, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN u.idx = f.idx THEN f.digest ELSE u.digest END, '' ORDER BY u.idx))
  FROM f2 f JOIN su u ON u.lvl = f.lvl AND u.idx // 3 = f.idx // 3 WHERE f.n > 1 GROUP BY f.lvl, f.doc_id, f.idx // 3, f.n)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p1.proof, '') || coalesce(p2.proof, '')) AS proof_sha256, f2.digest AS folded_root, f2.digest = r.root AS verified
FROM l JOIN s USING (tree) CROSS JOIN r LEFT JOIN p1 USING (doc_id) LEFT JOIN p2 USING (tree) JOIN f2 ON f2.doc_id = l.doc_id AND f2.n = 1
"""
