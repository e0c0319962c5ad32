"""Interaction of document filters: what each of them removes in every order in which they can be applied.

A document has a mask, one bit for each filter it fails. All figures of all orders follow from how many documents of a
part have each mask, so documents are judged once and only counts go on.

Filters on a document's own text are columns, evaluated in the scan. The last filter, exact duplicates, is an RDD routed
by fingerprint: rows go to the partition of their text's xxhash; there a fingerprint has a chain of different full texts (more than
one only if fingerprints collide), each with its smallest id, and every row with a larger id is emitted as a
duplicate. Map tasks do the same with what they read before anything is sent, in pieces of ``HELD`` letters, so a text with
a third of all rows costs one row a piece; its duplicates found there are known for good and are sent on without text, by
id. Partitions number as the text's bytes ask for (``PARTITION`` each). ``combineByKey`` then adds vectors of counts
(masks by all, good and toxic documents) for each part, map-side combined, and each part's vector makes its own rows.

Null texts are empty, so equal to each other; a null part is the empty string. A row with a null id is no duplicate and makes
none; rows with one id and one text aren't each other's duplicates and count each. A document is good or toxic if any of
its labels' rows says so; a null label says nothing. Other columns aren't read. Without documents there are no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Letters of text that a map task holds at once, and bytes of text for a partition of the routed rows.
HELD, PARTITION = 16_000_000, 64_000_000

#: A word, and what counts as a symbol.
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D on a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * upper > 3 * F.length(text), "D": text.rlike(SYMBOL)}


#: What travels: (fingerprint, (text or None, id, mask, Counter of parts)). Without a text the row is known to be a duplicate, or to be none.
Routed = tuple[int, tuple[str | None, int | None, int, Counter]]


class Chains:
    """Texts by fingerprint: chains of [text, smallest id, mask, parts of the rows with that id]."""

    def __init__(self, bit: int):
        self.bit, self.chains, self.letters = bit, {}, 0

    def add(self, print_: int, text: str, id_: int, mask: int, parts: Counter) -> Iterator[tuple[int, int, Counter]]:
        """Take a row in; yields the row that turns out not to have the smallest id."""
        chain = self.chains.setdefault(print_, [])
        for link in chain:
            if link[0] == text:
                if id_ == link[1]:
                    link[3] += parts
                    return
                late = (max(id_, link[1]), mask | self.bit, parts if id_ > link[1] else link[3])
                if id_ < link[1]:
                    link[1], link[3] = id_, parts
                yield late
                return
        chain.append([text, id_, mask, parts])
        self.letters += len(text)

    def close(self) -> Iterator[tuple[int, list]]:
        """The rows with the smallest ids, by fingerprint; nothing is held afterwards."""
        for print_, chain in self.chains.items():
            for link in chain:
                yield print_, link
        self.chains, self.letters = {}, 0


def _send(bit: int) -> Callable[[Iterator[Row]], Iterator[Routed]]:
    def run(rows: Iterator[Row]) -> Iterator[Routed]:
        held = Chains(bit)
        for id_, part, text, print_, mask in rows:
            if id_ is None:
                yield print_, (None, None, mask, Counter([part]))
                continue
            for late, failed, parts in held.add(print_, text, id_, mask, Counter([part])):
                yield late, (None, late, failed, parts)
            if held.letters > HELD:
                yield from ((p, tuple(link)) for p, link in held.close())
        yield from ((p, tuple(link)) for p, link in held.close())

    return run


def _receive(bit: int) -> Callable[[Iterator[Routed]], Iterator[tuple]]:
    def run(rows: Iterator[Routed]) -> Iterator[tuple]:
        held = Chains(bit)
        for print_, (text, id_, mask, parts) in rows:
            known = [(id_, mask, parts)] if text is None else held.add(print_, text, id_, mask, parts)
            for late, failed, own in known:
                yield from ((late, part, failed, n) for part, n in own.items())
        for _, (_, id_, mask, parts) in held.close():
            yield from ((id_, part, mask, n) for part, n in parts.items())

    return run


def masks(docs: DataFrame, filters: Callable[[Column], dict[str, Column]] = row_filters, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``doc_id``, ``part``, ``mask`` (bit i: fails filter i, the last bit: a duplicate) and ``n`` rows."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    own = filters(F.col("_t"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own.values())), F.lit(0))
    rows = docs.select(F.col(doc_id).cast("long").alias("_i"), F.coalesce(F.col(part), F.lit("")).alias("_p"), body.alias("_t"))
    size = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    bit = 1 << len(own)
    routed: RDD = rows.select("_i", "_p", "_t", F.xxhash64("_t"), mask).rdd.mapPartitions(_send(bit)).partitionBy(partitions, lambda k: k)
    return spark.createDataFrame(routed.mapPartitions(_receive(bit)), "doc_id long, part string, mask int, n long", verifySchema=False)


def _vector(size: int) -> Callable:
    def add(total: np.ndarray, row: tuple[int, int, bool, bool]) -> np.ndarray:
        mask, n, good, toxic = row
        total[:, mask] += (n, n * good, n * toxic)
        return total

    return lambda row, total=None: add(np.zeros((3, size), dtype=np.int64) if total is None else total, row)


def all_orders(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """The rows of a part: every order, every step, from the counts (all, good, toxic) of its masks."""
    of = np.arange(counts.shape[1])
    bits = {x: 1 << i for i, x in enumerate(letters)}
    rows, removed = [], Counter()
    for order in permutations(letters):
        alive = np.ones(len(of), dtype=bool)
        for step, x in enumerate(order, 1):
            fails = (of & bits[x]) > 0
            here = alive & fails
            gone, good, toxic = counts[:, here].sum(axis=1).tolist()
            redundant = int(counts[0, fails & ~alive].sum())
            alive &= ~fails
            removed[x] += gone
            rows.append((x, ("".join(order), step, int(counts[0, alive].sum()), gone, redundant, int(counts[0, bits[x]]), good, toxic)))
    return ((part, *row, removed[x]) for x, row in rows)


OUTPUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], dict[str, Column]] = row_filters, duplicates: str = "E", doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of all filters and step, zeros included."""
    spark = docs.sparkSession
    letters = "".join(filters(F.lit(""))) + duplicates
    failed = masks(docs, filters, doc_id, text, part).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    labelled = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    known = failed.join(labelled, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(False)), F.coalesce("toxic", F.lit(False)))
    vector = _vector(1 << len(letters))
    counts = known.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(vector, lambda total, row: vector(row, total), np.add, int(spark.conf.get("spark.sql.shuffle.partitions")), lambda p: zlib.crc32(p.encode()))
    return spark.createDataFrame(counts.flatMap(lambda kv: all_orders(kv[0], kv[1], letters)), OUTPUT, verifySchema=False)


#: DuckDB SQL for the query op13.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT x, min(doc_id) AS least FROM t GROUP BY x),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END)
  || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM t JOIN first USING (x) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE length(filter_order) < 5 AND strpos(filter_order, f) = 0),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
j AS (SELECT part, filter_order, step, f, n, good, toxic, fails, strpos(fails, f) > 0 AS here, translate(fails, earlier, '') <> fails AS before FROM c, s),
a AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT here AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (WHERE here AND before), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE here AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT before), 0) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM a
"""
