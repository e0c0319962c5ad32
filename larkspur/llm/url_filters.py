"""URL filter by rules on host and path, with DataFrame functions only: a Bloom filter cascade instead of a join.

A rule is a host and the beginning of a path; its key is both, one after the other (``example.org/es/``). It fits its host and
all subdomains of it if the url's path starts with the rule's. All rules have few shapes (labels of the host, letters of the
path), so a url has one possible key for each shape, and the distinct keys of all urls are the universe of what will ever be
asked. Over a universe that is known whole, Bloom filters can be made exact: level 0 holds the listed keys; level 1 the
keys of the universe that pass level 0 without being listed; level 2 the listed keys that pass level 1; and so on until nothing
passes wrongly. A key is listed if the first level that it doesn't pass is odd. One cascade tells listed keys from all
others, a second one blocked rules from allowed ones.

Shape of the plans: the universe is counted approximately (a sketch), those of its keys that pass level 0 are brought
together by a map-side combined aggregate, in proportion to the rules (level 0 lets about as many pass as there are rules).
Later levels read this small table alone. Pages are judged in their scan, without any exchange. What goes into the plan of every
task is the cascades' bits, ``MOST_BITS`` at most: some 20 a rule against 10^5 times as many other keys.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.
A null url, or one without ``://``, has empty ones. Of the rules that fit, the longest (letters of its key) wins, of two of one
length the one with the longer host. Urls that no rule fits get the verdict of the method: a list says nothing about what it
doesn't hold, so they are allowed (``otherwise``). Of equal rules with both verdicts, block wins; a rule with a null or empty
host fits nothing, a null path is empty, a rule's verdict other than ``block`` allows. Without rules every url is allowed.
Repeated pages are judged one by one; columns of the input stay, but for those with an output's name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.line_dedup import ascii_lower
from larkspur.llm.workspace import Stash

#: The bits that a level may have (64 MB); more rules than that are refused.
MOST_BITS = 1 << 29


def host_and_path(url: Column) -> tuple[Column, Column]:
    cut = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, cut, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``hashes`` places among ``bits``; the 64-bit words are a literal of the plan."""

    number: int
    bits: int
    hashes: int
    words: Column

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        held = F.lit(True)
        for at in self.places(key):
            held = held & (F.getbit(F.get(self.words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return held


def _level(keys: DataFrame, number: int, n: int, wrong: float) -> Level:
    """The filter of ``n`` keys (column ``key``) that lets a share ``wrong`` of other keys pass."""
    hashes = max(1, round(math.log2(1 / wrong)))
    bits = 64 * max(1, math.ceil(1.4427 * hashes * n / 64))
    if bits > MOST_BITS:
        raise ValueError(f"{n} keys need {bits} bits of a filter, {MOST_BITS} are allowed: split the rules")
    empty = Level(number, bits, hashes, F.lit(None))
    at = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("at"))
    words = [0] * (bits // 64)
    for r in at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("held")).collect():
        words[r["word"]] = r["held"]
    return Level(number, bits, hashes, F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"))


class Cascade:
    """Exact membership among the keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            found = F.when(level.passes(key), found).otherwise(F.lit(level.number % 2 == 1))
        return found


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the keys ``listed`` among all keys of ``universe`` (both: column ``key``, repeated or not)."""
    n = listed.distinct().count()
    if not n:
        return Cascade([])
    others = universe.agg(F.approx_count_distinct("key")).first()[0]
    first = _level(listed, 0, n, min(0.5, max(2.0**-30, n / (math.sqrt(2) * max(1, others)))))
    told = listed.select("key", F.lit(True).alias("listed")).unionByName(universe.where(first.passes(F.col("key"))).select("key", F.lit(False).alias("listed")))
    stash = Stash(listed.sparkSession)
    table, path = stash.save(told.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    levels = [first]
    held, other = table.where(~F.col("listed")), table.where("listed")
    while left := held.count():
        levels.append(_level(held, len(levels), left * (1 + len(levels) // 64), 0.5))
        held, other = other.where(levels[-1].passes(F.col("key"))), held
    stash.drop(path)
    return Cascade(levels)


def rule_keys(rules: DataFrame) -> DataFrame:
    """``key``, ``labels``, ``letters`` and ``block`` of rules (host, path, verdict), one row a key."""
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    known = rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
    shaped = known.select(F.concat(host, path).alias("key"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("letters"), (F.coalesce("verdict", F.lit("")) == "block").alias("block"))
    return shaped.groupBy("key", "labels", "letters").agg(F.max("block").alias("block"))


def possible_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """All keys of rules of these shapes that could fit; a host with fewer labels or a shorter path gives its whole."""
    return F.array(*[F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, letters)) for labels, letters in shapes]).cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (its key, null if none fits) and verdict."""
    pages = pages.drop("host", "path", "rule", "verdict")
    keys = rule_keys(rules)
    shapes = sorted((r["labels"], r["letters"]) for r in keys.select("labels", "letters").distinct().collect())
    host, path = host_and_path(F.col(url))
    universe = pages.select(F.explode(possible_keys(host, path, shapes)).alias("key"))
    listed = cascade(keys.select("key"), universe)
    blocked = cascade(keys.where("block").select("key"), keys.select("key"))
    longest: Callable[[Column], Column] = lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key"))
    best = F.array_max(F.transform(F.filter(possible_keys(F.col("host"), F.col("path"), shapes), listed.holds), longest))["key"]
    found = pages.withColumns({"host": host, "path": path}).withColumn("rule", best)
    return found.withColumn("verdict", F.when(F.col("rule").isNull(), otherwise).when(blocked.holds(F.col("rule")), "block").otherwise("allow"))


#: Fixed by the contract of op12: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: DuckDB SQL for the query op12.
SQL = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, host, path, f.rule, coalesce(f.v, 'allow') AS verdict FROM s LEFT JOIN f ON s.page_id = f.page_id AND f.n = 1
"""
