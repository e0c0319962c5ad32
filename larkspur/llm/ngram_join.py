"""N-gram Jaccard self-join with adaptive multi-match prefixes, to classes of linked documents.

A document is the set of its distinct word n-grams (A-Z lower-cased, words separated by ASCII white space), each as
a 64-bit hash. Documents link when intersection / union reaches ``share / of``; classes are connected components.

1. One pass hashes every set and counts n-grams and words in two sketches of ``COUNTERS`` counters, which order n-grams
   from rare to common (:class:`Counts`). The sketches are of fixed size (4 MB each), so they can be broadcast for any input; any order gives the
   same result, a better one fewer candidates. For each set it also makes a bitmap of about 8 (1 - t) bits an element.
2. A set of n elements that links with another has ceil(t n) in common with it, so among the first
   n - ceil(t n) + l elements of both there are l common ones. l is chosen for each document by estimated cost:
   a longer prefix costs rows, but pairs must then share l elements before they are verified. For
   documents with different l the smaller counts.
3. Prefix elements meet by hash, in a stream sorted within each partition. Runs of up to ``RUN`` documents give
   pairs, which count if they share l elements and lengths and bitmaps allow them to link. A longer run would give too many pairs: its documents form a group
   (:mod:`blocks`), in which a pair is a candidate if lengths and bitmaps allow it to link. A bitmap holds for each
   bit whether the elements hashed to it are odd in number, so two sets differ in at least as many elements as their
   bitmaps do in bits: a necessary condition on whole sets, stricter than l shared prefix elements. Without it, pairs that
   share l elements by chance, more of them the more documents there are, would join most documents to one group. Elements that
   the sketch calls very common are such groups from the start, whatever their runs would be: their rows are spread over
   all tasks, so no task sorts the run of a hot element.
4. Components of candidates are groups again, in which sets are compared by exact intersection, of the length that allows it.
   Only documents that a Bloom filter of bounded size passes are hashed again for this, and only sets are sent.

Equal sets are one node from the start (each map task emits a set once), so copies never meet in pairs. A set is
identified by 128 bits of fingerprint; the 64 bits by which prefixes meet only bring candidates together.

Null and empty texts have no words: their sets are empty and link with nothing. With fewer than n words the whole
sequence is the one element. Rows with a null id link like others but give a class no id: where no row of a class has
one, its component is null. Repeated rows have rows of their own; an id repeated with other texts stands for each of
its sets, which aren't linked by sharing it, and a class may have the smallest id of several. Texts of any length are
hashed whole. Ties don't occur: a class has one smallest id. An empty table gives an empty result. Other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks, filters, memory, ragged
from larkspur.llm.components import components, skew_join
from larkspur.llm.workspace import Stash

COUNTERS, PART = 1 << 20, 1 << 12
CACHE_WORDS, LONG_WORD = 150_000, 64
#: Documents of a run that gives pairs; elements, and bytes of bitmaps, that one task compares; the largest l.
RUN, BLOCK, CROWD, MOST_MATCHES = 64, 250_000, 500_000, 8
#: Documents, beyond twice what a counter holds on average, from which an element counts as very common.
HOT = 1024


@dataclass(frozen=True)
class Join:
    """N-gram length, and the least similarity as a fraction."""

    words: int = 5
    share: int = 4
    of: int = 5

    def least(self, n: np.ndarray) -> np.ndarray:
        """ceil(t n)"""
        return -(-n * self.share // self.of)


# -- sets -------------------------------------------------------------------------------------------------


class _Words(dict):
    """Hashes of words, computed once but for long ones; starts anew when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text and its n-grams, one after the other, as hashes."""
    own = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    memory.claim(_words, _words.clear)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, own), dtype=np.uint64, count=len(own))
    n = max(1, len(h) - words + 1)
    m = min(words, len(h))
    out = np.full(n, m, dtype=np.uint64)
    for i in range(m):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return h, out


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text, sorted."""
    return np.unique(hashed(text, words)[1])


def counter(hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in a sketch."""
    return (hashes >> np.uint64(44)).astype(np.int64)


def set_id(elements: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set, as two signed numbers."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x9FB21C651E98DF25):
        total = int(_mix(elements ^ np.uint64(salt)).sum(dtype=np.uint64)) + len(elements) * 0x14057B7EF767814F
        out.append(int(_mix(np.array([total % 2**64], dtype=np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


def bitmap(elements: np.ndarray, join: Join) -> np.ndarray:
    """Parities of the elements in 64-bit words of bits: a power of two, and enough for sets that have little in common
    to differ in clearly more bits than sets that link may."""
    least = max(1, 8 * len(elements) * (join.of - join.share) // join.of)
    bits = max(64, 1 << (least - 1).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A bitmap as one of n words would be."""
    return np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def _sets_and_sketch(docs: DataFrame, join: Join) -> DataFrame:
    """A row for each document (doc_id, n, sid, more, mark, bits), and from each task its counters in parts (part, bits):
    those of n-grams, then those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, waiting = np.zeros((2, COUNTERS), dtype=np.int64), [], 0

        def count() -> None:
            nonlocal held, waiting
            if waiting:
                for own, hashes in zip(sketch, zip(*held, strict=True), strict=True):
                    np.add(own, np.bincount(counter(np.concatenate(hashes)), minlength=COUNTERS), out=own)
            held, waiting = [], 0

        for batch in batches:
            for part in ragged.slices(batch, "text"):
                sets = []
                for text in ragged.texts(part, "text"):
                    words, grams = hashed(text, join.words)
                    sets.append(np.unique(grams))
                    held.append((sets[-1], words))
                    waiting += len(words)
                if waiting > COUNTERS:
                    count()
                sid, more = (pa.array(x, pa.int64()) for x in zip(*map(set_id, sets), strict=True))
                bits = pa.array([bitmap(s, join).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), sid, more, part.column("mark"), pa.nulls(len(sets), pa.int32()), bits], schema=_SETS)
        count()
        parts = sketch.reshape(-1, PART)
        full = np.flatnonzero(parts.any(axis=1)).tolist()
        if full:
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none, none, none, pa.array(full, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in full], pa.binary())], schema=_SETS)

    return docs.mapInArrow(run, "doc_id long, n int, sid long, more long, mark long, part int, bits binary")


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("more", pa.int64()), ("mark", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])


class Counts:
    """How common n-grams are, by two sketches.

    A counter of n-grams holds all that fall to it, rare ones too: the larger the table, the less it says of an n-gram that
    isn't very common. So it counts only by what it has beyond the others. Besides, an n-gram counts as common as its words
    would make it if they stood together by chance: most of what is written are a few very common words, so rare words
    are known for rare in a table of any size. The estimate is made of products alone, so it is the same in all tasks."""

    def __init__(self, grams: np.ndarray, words: np.ndarray):
        self.grams, self.words, self.total = grams, words, float(words.sum(dtype=np.uint64))
        middle, high = np.quantile(grams, (0.5, 0.84))
        self.floor, self.hot = float(middle + 3 * (high - middle)), 2 * float(grams.mean()) + HOT

    def look(self, words: np.ndarray, m: int, elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the elements of a set, each m words that are first found at a place in the text: in how many documents each may be, and whether it is very common."""
        many = self.words[counter(words)].astype(np.float64)
        chance = np.full(len(elements), self.total)
        for i in range(m):
            chance *= many[first + i] / self.total
        count = self.grams[counter(elements)]
        return np.maximum(chance, count - self.floor), count > self.hot


def _sketch(rows: DataFrame) -> Counts:
    """The counters of all tasks added up: as a stream, whatever the number of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
                total[part] = total[part] + own if part in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((2 * COUNTERS // PART, PART), dtype=np.int64)
    for r in rows.select("part", F.col("bits").alias("counts")).repartition("part").mapInArrow(add, "part int, counts binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return Counts(*np.minimum(out.reshape(2, COUNTERS), 2**32 - 1).astype(np.uint32))


# -- candidates -------------------------------------------------------------------------------------------


def matches_needed(others: np.ndarray, n: int, base: int) -> int:
    """The l of least estimated cost. ``others``: for the elements from rare to common, in how many other documents each
    may be; ``base``: prefix length without l. A pair that shares one element by chance shares each further one with a
    small probability, and verifying a pair costs as much as the set is long."""
    most = min(MOST_MATCHES, n - base)
    met = np.cumsum(others[: base + most])[base:]
    cost = [base + k + n * met[k - 1] * 0.2 ** (k - 1) for k in range(1, most + 1)]
    return int(np.argmin(cost)) + 1


def _prefixes(docs: DataFrame, join: Join, counts: Counts) -> DataFrame:
    """The prefix elements of each set once in a task: element, set, its length, its l, and the l from which the element counts.

    An l of 0 marks a very common element. The sketches are the same for all tasks, so all of an element's rows have the mark or none."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                out = []
                for text in ragged.texts(part, "text"):
                    words, grams = hashed(text, join.words)
                    own, first = np.unique(grams, return_index=True)
                    n = len(own)
                    if not n or (sid := set_id(own)) in seen:
                        continue
                    seen.add(sid)
                    held, common = counts.look(words, min(join.words, len(words)), own, first)
                    order = np.lexsort((own, held))
                    base = n - int(join.least(np.array(n)))
                    need = matches_needed(held[order] + 1.0, n, base)
                    pick = order[: base + need]
                    level = np.maximum(1, np.arange(base + need) - base + 1)
                    out.append((own[pick].view(np.int64), np.full(len(pick), sid[0]), np.full(len(pick), n), np.where(common[pick], 0, need), level))
                if out:
                    element, sid, n, need, level = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(element), pa.array(sid), *[pa.array(x.astype(np.int32)) for x in (n, need, level)]], names=_PREFIX.names)

    return docs.mapInArrow(run, _PREFIX)


_PREFIX = T.StructType([T.StructField("element", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("level", T.IntegerType())])


def _meet(prefixes: DataFrame, join: Join) -> DataFrame:
    """Pairs (a, b, need) from short runs; members (a: set, b: element, need: -length) of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        long_run: int | None = None  # the element of a run that has begun to give members
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            common = cols[3] == 0
            if common.any():
                yield _members(*(c[common] for c in cols[:3]))
                cols = [c[~common] for c in cols]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            element = cols[0]
            last = int(np.searchsorted(element, element[-1], side="left"))
            if len(element) - last > RUN:  # the open run is long already: let go of what there is
                yield from _pairs([c[:last] for c in cols], long_run, join)
                long_run = int(element[-1])
                yield _members(*(c[last:] for c in cols[:3]))
                rest = [c[:0] for c in cols]
            else:
                yield from _pairs([c[:last] for c in cols], long_run, join)
                rest = [c[last:] for c in cols]
        if rest is not None:
            yield from _pairs(rest, long_run, join)

    spread = prefixes.repartition("element", F.when(F.col("need") == 0, F.col("sid")))
    return spread.sortWithinPartitions("element").mapInArrow(run, "a long, b long, need int")


def _members(element: np.ndarray, sid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    sid, element, n = np.unique(np.stack([sid, element, n]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(element), pa.array(-n.astype(np.int32))], names=["a", "b", "need"])


def _pairs(cols: list[np.ndarray], long_run: int | None, join: Join) -> Iterator[pa.RecordBatch]:
    if not len(cols[0]):
        return
    element, sid, n, need, level = cols
    order = np.lexsort((level, need, n, sid, element))
    own = np.stack([c[order] for c in cols])
    keep = np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0))  # a set comes from several tasks
    element, sid, n, need, level = (c[order[keep]] for c in cols)
    at = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
    size = np.diff(np.append(at, len(element)))
    crowded = (size > RUN) | (element[at] == long_run if long_run is not None else False)
    if crowded.any():
        rows = ragged.take(at[crowded], size[crowded])
        yield _members(element[rows], sid[rows], n[rows])
    for g in np.unique(size[~crowded & (size > 1)]).tolist():
        starts = at[~crowded & (size == g)]
        i, j = np.triu_indices(g, 1)
        step = max(1, 200_000 // len(i))
        for k in range(0, len(starts), step):
            x, y = ((starts[k : k + step, None] + own).ravel() for own in (i, j))
            least = np.minimum(need[x], need[y])
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (level[x] <= least) & (level[y] <= least) & (small.astype(np.int64) * join.of >= large.astype(np.int64) * join.share)
            x, y, least = x[ok], y[ok], least[ok]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[x], sid[y])), pa.array(np.maximum(sid[x], sid[y])), pa.array(least)], names=["a", "b", "need"])


def _allowed(x: np.ndarray, y: np.ndarray, differ: np.ndarray, join: Join) -> np.ndarray:
    """Whether sets of x and y elements may link whose bitmaps differ in so many bits."""
    # At a Jaccard similarity of t the symmetric difference is at most (1 - t) / (1 + t) of both lengths.
    return (np.minimum(x, y) * join.of >= np.maximum(x, y) * join.share) & (differ * (join.of + join.share) <= (x + y) * (join.of - join.share))


def may_link(join: Join) -> blocks.Near:
    """Which sets lengths and bitmaps allow to link; a payload is the length in 8 bytes, and the bitmap."""

    def near(payloads: list[bytes]):
        size = np.array([int.from_bytes(p[:8], "little") for p in payloads], dtype=np.int64)
        bits = [np.frombuffer(p, dtype=np.uint64, offset=8) for p in payloads]
        width = min(map(len, bits))
        table = np.stack([folded(b, width) for b in bits])

        def compare(x: int, others: np.ndarray) -> np.ndarray:
            others = others[np.minimum(size[others], size[x]) * join.of >= np.maximum(size[others], size[x]) * join.share]
            differ = np.bitwise_count(table[others] ^ table[x]).sum(axis=1, dtype=np.int64)
            return others[_allowed(size[others], size[x], differ, join)]

        return compare

    return near


def may_link_pairs(x: list[bytes], y: list[bytes], join: Join) -> np.ndarray:
    """Of pairs of such payloads, those that :func:`may_link` allows."""
    out = np.zeros(len(x), dtype=bool)
    wide = np.array([[len(p) // 8 - 1 for p in own] for own in (x, y)]).reshape(2, -1)
    for widths in np.unique(wide, axis=1).T:
        at = np.flatnonzero((wide == widths[:, None]).all(axis=0))
        own = [np.frombuffer(b"".join([p[i] for i in at]), dtype=np.uint64).reshape(len(at), -1) for p in (x, y)]
        bits = [np.bitwise_xor.reduce(o[:, 1:].reshape(len(at), -1, widths.min()), axis=1) for o in own]
        differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
        out[at] = _allowed(*(o[:, 0].astype(np.int64) for o in own), differ, join)
    return out


def _close(pairs: DataFrame, known: DataFrame, join: Join) -> DataFrame:
    """Those of the pairs (a, b) that lengths and bitmaps allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                own = pa.array(may_link_pairs(part.column("x").to_pylist(), part.column("y").to_pylist(), join))
                yield part.select(["a", "b"]).filter(own)

    for end, payload in (("a", "x"), ("b", "y")):
        pairs = skew_join(pairs, known.select(F.col("node").alias(end), F.col("payload").alias(payload)), [end])
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _candidates(met: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that connect all sets that may link: pairs, and links within the long runs."""
    stash = Stash(met.sparkSession)
    pairs = met.where(F.col("need") > 0).groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.col("need")).select("a", "b")
    pairs, pairs_path = stash.save(pairs, "pairs")
    members = met.where(F.col("need") < 0).select("a", "b", (-F.col("need")).alias("n")).distinct()
    # Sets of one length class may link; one that may link with sets of the next class comes to both.
    ratio = join.of / join.share
    step = lambda n: F.floor(F.log(n) / (4 * float(np.log(ratio)))) if ratio > 1 else n
    place = F.explode(F.array_distinct(F.array(step(F.col("n")), step(F.col("n") * ratio * (1 + 1e-9) if ratio > 1 else F.col("n")))))
    members = members.withColumn("c", place).select(F.xxhash64("b", "c").alias("g"), F.col("a").alias("node"), (16 + F.col("n") / 8).cast("long").alias("size"))
    members, path = stash.save(members, "crowds")
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).unionByName(members.select(F.col("node").alias("sid"))).distinct()
    known = skew_join(sets.where(F.col("n") > 0).select("sid", "more", "n", "bits"), wanted, ["sid"])  # before copies are counted once
    n = F.col("n").cast("long")  # an int shifted by 32 bits isn't shifted at all
    head = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8)]))
    known = known.groupBy("sid", "more").agg(F.first(F.concat(head, "bits")).alias("payload"))
    known, bitmaps = stash.save(known.select(F.col("sid").alias("node"), "payload"), "bitmaps")
    close, _ = stash.save(_close(pairs, known, join), "close")
    stash.drop(pairs_path)
    found = blocks.link_groups(members, lambda rows: skew_join(rows, known, ["node"]), may_link(join), CROWD)
    stash.drop(path)
    stash.drop(bitmaps)
    return close.unionByName(found)


# -- verification -----------------------------------------------------------------------------------------


def linked(join: Join) -> blocks.Near:
    """Which sets link, by exact intersections."""

    def near(payloads: list[bytes]):
        sets = [np.frombuffer(p, dtype=np.uint64) for p in payloads]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        start = ragged.offsets(size)
        mark = np.zeros(len(flat), dtype=np.int32)

        def compare(x: int, others: np.ndarray) -> np.ndarray:
            others = others[np.minimum(size[others], size[x]) * join.of >= np.maximum(size[others], size[x]) * join.share]
            if not len(others):
                return others
            own = flat[start[x] : start[x + 1]]
            mark[own] = 1
            hits = np.add.reduceat(mark[flat[ragged.take(start[others], size[others])]], ragged.offsets(size[others])[:-1]).astype(np.int64)
            mark[own] = 0
            return others[hits * join.of >= join.share * (size[others] + size[x] - hits)]

        return compare

    return near


def _elements(docs: DataFrame, wanted: filters.Sieve, join: Join) -> DataFrame:
    """(sid, more, payload) of the documents whose id may be wanted or is null: each set once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch.filter(pc.or_(wanted.passes(batch.column("doc_id")), batch.column("doc_id").is_null()))
            for part in ragged.slices(batch, "text") if batch.num_rows else ():
                sets = {}
                for text in ragged.texts(part, "text"):
                    own = shingles(text, join.words)
                    if len(own) and (sid := set_id(own)) not in seen:
                        seen.add(sid)
                        sets[sid] = own.tobytes()
                if sets:
                    sid, more = (pa.array(x, pa.int64()) for x in zip(*sets, strict=True))
                    yield pa.RecordBatch.from_arrays([sid, more, pa.array(list(sets.values()), pa.binary())], names=["sid", "more", "payload"])

    return docs.mapInArrow(run, "sid long, more long, payload binary")


def classes(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, n_shingles (set size) and component_id (the smallest id reachable by links, itself included)."""
    found = class_nodes(docs, join, doc_id, text)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def class_nodes(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, n, its set (sid, more), a hash of its text (mark), and its class: ``component`` (the smallest id) and ``class`` (a number
    that all documents of a class share), both null for a document that is linked with no other."""
    stash = Stash(docs.sparkSession)
    use = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both, _ = stash.save(_sets_and_sketch(use.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))), join), "sets")
    rows = both.where(F.col("part").isNull()).select("doc_id", "n", "sid", "more", "mark", "bits")
    nodes = rows.drop("bits")
    counts = _sketch(both.where(F.col("part").isNotNull()))
    met, met_path = stash.save(_meet(_prefixes(use, join, counts), join), "met")
    candidates = components(_candidates(met, rows, join))
    stash.drop(met_path)
    # Each set has a number of its own; the smallest id of its documents finds its text again.
    sets = nodes.where(F.col("n") > 0).groupBy("sid", "more").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    members = candidates.select(F.col("node").alias("sid"), F.col("root").alias("g")).unionByName(candidates.select(F.col("root").alias("sid"), F.col("root").alias("g")).distinct())
    sets, sets_path = stash.save(sets.join(members, "sid", "left").where((F.col("copies") > 1) | F.col("g").isNotNull()).withColumn("node", F.monotonically_increasing_id()), "classes")
    involved = sets.where(F.col("g").isNotNull())

    def load(rows: DataFrame) -> DataFrame:
        placed = rows.join(involved.select("node", "sid", "more", "rep"), "node")
        return _elements(use, filters.sieve(placed, "rep"), join).join(placed, ["sid", "more"])

    links = blocks.link_groups(involved.select("g", "node", F.col("n").alias("size")), load, linked(join), BLOCK)
    roots = components(links)
    named, _ = stash.save(sets.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).where((F.col("copies") > 1) | F.col("root").isNotNull() | F.col("g").isNotNull()), "named")
    least = named.groupBy("class").agg(F.min("rep").alias("component"))
    named = skew_join(named.select("sid", "more", "class"), least, ["class"])
    stash.drop(sets_path)
    return skew_join(nodes, named, ["sid", "more"], "left").select("doc_id", "n", "sid", "more", "mark", "component", "class")


def one_of_each_class(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of linked documents: the one with the smallest id, nulls last.

    Of several rows with that id the one with the smallest fingerprint of its set and text stays, of rows that agree in
    these too the one that is least in all its columns, once. Documents without words are in no class and all stay."""
    stash = Stash(docs.sparkSession)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    key = ["alone", "k", "l"]  # a class, or else a set
    alone = F.col("class").isNull()
    found = class_nodes(docs, join, doc_id, text).where("n > 0").select(alone.alias("alone"), F.coalesce("class", "sid").alias("k"), F.when(alone, F.col("more")).otherwise(0).alias("l"), F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("d"), "sid", "more", "mark")
    found, found_path = stash.save(found, "found")
    rows = found.groupBy(*key, "x", "d", "sid", "more", "mark").agg(F.count(F.lit(1)).alias("c"))
    first = found.groupBy(*key).agg(F.min(F.struct("x", "d", "sid", "more", "mark")).alias("first"))
    fate = skew_join(rows, first, key).withColumn("stays", F.struct("x", "d", "sid", "more", "mark") == F.col("first"))
    fate, _ = stash.save(fate.where(~F.col("stays") | (F.col("c") > 1)).select("x", "d", "mark", "stays"), "fate")
    stash.drop(found_path)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).isNull().alias("x"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("d"), mark.alias("mark"))
    kept = whole.join(fate, ["x", "d", "mark"], "left_anti").select("row.*")
    repeated = fate.where("stays")
    if repeated.isEmpty():
        return kept
    # Columns with a map have no order; they go by their JSON.
    order = [F.to_json(F.struct(F.col("row")[f.name])) if "map<" in f.dataType.simpleString() else F.col("row")[f.name] for f in docs.schema.fields]
    again = whole.join(repeated, ["x", "d", "mark"]).groupBy("x", "d", "mark").agg(F.min_by("row", F.struct(*order)).alias("row"))
    return kept.unionByName(again.select("row.*"))
