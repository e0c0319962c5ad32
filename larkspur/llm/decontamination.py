"""Benchmark decontamination: near copies of benchmark items in documents, by word edit distance.

An item counts as leaked into a document if some stretch of the document is within ``1 - similarity`` of the
item's words in edits (insert, drop, change a word). Words are runs of letters, digits and underscores,
lower-cased; in scripts that are written without spaces each letter is a word of its own. Items of fewer than
``min_words`` words are so few that all places are verified where a run of their words stands that ``similarity`` must
leave unbroken; where it allows them no edit (at 0.8), that run is the item.

Candidates come from CGK embeddings. A random walk over a word sequence emits the word under its pointer at
every step and moves on by a random bit of (walk, step, word); few edits between two sequences become few
differences between their walks, so edit distance is mapped to Hamming distance. Bit sampling makes hash keys of
``samples`` steps each; ``walks`` x ``tables`` keys for every window give the target recall. A window is as
long as the items of its size class: steps are sampled from what a walk over the shortest of them covers.
Each pair of window and item that shares a key is verified by exact edit distance (bit-parallel).

A long item is looked for by its pieces of ``piece_words`` words at most: as its edits fall into one piece or another, one piece
at least has no greater share of edits than the item may have. The whole item is verified around a piece's place.

Walks are only made where they can lead anywhere: an item of n words with k edits keeps a run of at least
(n - k) / (k + 1) of its words (or a piece's) unbroken, so windows must begin at most an item's length before such a run. That
condition is necessary for every pair that verification can confirm; it loses none and names no item.

Different item texts go to the executors in blocks, one pass over the documents for each. What is sent for a text (its words,
runs and keys, about 1,300 bytes a piece) is reckoned beforehand, and a block is filled up to ``block_bytes`` of it; only a text
that is larger by itself makes a larger block. So what is collected and broadcast is bounded however many items there are. Of
several blocks the driver holds one at a time; its matches are stored and its broadcast destroyed before the next.
Copies of an item are looked for once; their ids are joined to the matches.

Items without a word (null and empty ones among them) are not looked for. Null and empty documents contain nothing;
documents of any length are searched whole. Of several places of an item in a document the one with the fewest edits is
told, of equally good ones the first. Repeated items and documents each have rows of their own; null ids stay null; an
empty table on either side gives no rows; other columns are ignored, whatever their names (``remove`` keeps those of
the documents).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import ragged
from larkspur.llm.components import skew_join
from larkspur.llm.workspace import Stash

#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana and bopomofo, and Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{UNSPACED}]+|(?=[{UNSPACED}])\w")
#: Symbols that are no word of any item, and what follows the end of a sequence.
OTHER, PAD = -1, -2
MATCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


@dataclass(frozen=True)
class Settings:
    """Defaults find nine of ten items at least that have all the edits they may have (the tests ask that, for 5 to 200 words).

    ``block_bytes``: what a block of items may take when it is sent."""

    similarity: float = 0.8
    min_words: int = 5
    piece_words: int = 40
    walks: int = 8
    tables: int = 12
    samples: int = 3
    size_step: float = 1.4
    seed: int = 20240229
    block_bytes: int = 64_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(keys: np.ndarray, n: int) -> np.ndarray:
    """Which values of their first n bits the keys have."""
    bits = np.zeros(1 << n, dtype=bool)
    bits[(keys >> np.uint64(64 - n)).astype(np.int64)] = True
    return bits


def best_edits(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Fewest edits that make ``pattern`` of a stretch of ``text``, and where the first such stretch ends (bit-parallel)."""
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, s in enumerate(pattern):
        where[s] = where.get(s, 0) | 1 << i
    plus, minus, score = full, 0, n
    best, end = n, 0
    for at, s in enumerate(text, 1):
        eq = where.get(s, 0)
        across = ((((eq & plus) + plus) ^ plus) | eq) & full
        down = eq | minus
        more, less = minus | (full & ~(across | plus)), plus & across
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1) & full, (less << 1) & full
        plus, minus = less | (full & ~(down | more)), more & down
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """One block of benchmark items, with the keys of their walks."""

    def __init__(self, item_ids: list, texts: list[str | None], settings: Settings):
        if not 0 < settings.similarity <= 1:
            raise ValueError("similarity must be over 0 and at most 1")
        self.settings = settings
        self.vocabulary: dict[str, int] = {}
        by_words: dict[tuple[int, ...], list] = {}  # equal sequences of words are looked for once
        for item, text in zip(item_ids, texts, strict=True):
            words = WORD.findall((text or "").lower())
            if words:
                by_words.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), []).append(item)
        long, short = ([w for w in by_words if (len(w) >= settings.min_words) == x] for x in (True, False))
        self.words: list[list[int]] = [list(w) for w in long + short]
        #: The items of each sequence of words.
        self.ids: list[list] = [by_words[w] for w in long + short]
        self.edits = [self._allowed(len(w)) for w in self.words]
        self.walked = len(long)
        #: What walks are made for: a piece of an item, its place in it, and its words.
        pieces: list[list[int]] = []
        piece_item, piece_at = [], []
        for i, w in enumerate(self.words[: self.walked]):
            cuts = np.linspace(0, len(w), -(-len(w) // settings.piece_words) + 1).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.append(w[a:b])
                piece_item.append(i)
                piece_at.append(a)
        self.piece_item, self.piece_at = np.array(piece_item, dtype=np.int64), np.array(piece_at, dtype=np.int64)
        self.run_keys: dict[int, np.ndarray] = {}
        self.classes: list[list] = []
        if pieces:
            self._runs(pieces)
            self._classes(pieces)
        self._short()
        self._look_up()

    def _allowed(self, n: int) -> int:
        return int(math.floor((1 - self.settings.similarity) * n + 1e-9))

    def _look_up(self) -> None:
        """Bit tables before the keys; made again where a block arrives."""
        self.run_bits = {g: _bits(keys, 20) for g, keys in self.run_keys.items()}
        self.key_bits = [_bits(x[4], 16) for x in self.classes]
        self.short_bits = {g: _bits(keys, 20) for g, (keys, _, _) in self.short.items()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("run_bits", "key_bits", "short_bits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._look_up()

    def _runs(self, pieces: list[list[int]]) -> None:
        self.longest = max(len(w) + self._allowed(len(w)) for w in pieces)
        runs: dict[int, list[int]] = {}
        for w in pieces:
            g = self._unbroken(len(w))
            runs.setdefault(g, []).extend(self.grams(np.array(w, dtype=np.int64), g).tolist())
        self.run_keys = {g: np.unique(np.array(x, dtype=np.uint64)) for g, x in runs.items()}

    def _unbroken(self, n: int) -> int:
        """Length of a run that n words keep however their edits fall."""
        k = self._allowed(n)
        return math.ceil((n - k) / (k + 1))

    def _short(self) -> None:
        """Items below ``min_words``: the hashes of their unbroken runs by length, with the items and the places in them."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for i in range(self.walked, len(self.words)):
            g = self._unbroken(len(self.words[i]))
            h = self.grams(np.array(self.words[i], dtype=np.int64), g).tolist()
            runs.setdefault(g, []).extend((x, i, at) for at, x in enumerate(h))
        self.short = {}
        for g, rows in sorted(runs.items()):
            rows.sort()
            h, i, at = zip(*rows, strict=True)
            self.short[g] = np.array(h, dtype=np.uint64), np.array(i, dtype=np.int32), np.array(at, dtype=np.int32)

    def _find_short(self, flat: np.ndarray, begin: np.ndarray, found: dict) -> None:
        """Verify short items wherever one of their runs stands; about a million places at a time."""
        for g, (keys, items, places) in self.short.items():
            h = self.grams(flat, g)
            at = np.flatnonzero(self.short_bits[g][(h >> np.uint64(44)).astype(np.int64)])
            doc = np.searchsorted(begin, at, side="right") - 1
            inside = at + g <= begin[doc + 1]
            at, doc = at[inside], doc[inside]
            lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], side="right")
            part = np.cumsum(hi - lo) // 1_000_000
            for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                n = hi[own] - lo[own]
                which = ragged.take(lo[own], n)
                self._verify(flat, begin, np.repeat(doc[own], n), np.repeat(at[own], n) - places[which], items[which].astype(np.int64), found)

    @staticmethod
    def grams(words: np.ndarray, g: int) -> np.ndarray:
        """A hash of the g words that begin at each place."""
        n = len(words) - g + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = np.full(n, g, dtype=np.uint64)
        for i in range(g):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n].astype(np.uint64) + np.uint64(1))
        return h

    def _classes(self, pieces: list[list[int]]) -> None:
        s = self.settings
        rng = np.random.default_rng(s.seed)
        lengths = np.array([len(w) for w in pieces])
        klass = np.floor(np.log(lengths / s.min_words) / math.log(s.size_step) + 1e-9).astype(int)
        for c in np.unique(klass):
            own = np.flatnonzero(klass == c)
            steps = max(s.samples, int(1.5 * lengths[own].min()))
            picks = [[np.sort(rng.choice(steps, size=s.samples, replace=False)) for _ in range(s.tables)] for _ in range(s.walks)]
            self.classes.append([c, own, steps, picks, None, None])
        self.steps = max(x[2] for x in self.classes)
        flat = np.array([x for w in pieces for x in w], dtype=np.int64)
        at = ragged.offsets(lengths)
        for k, (_, own, _, _, _, _) in enumerate(self.classes):
            keys, items = [], []
            for table, key, known in self.keys(flat, at[own], at[own + 1], [k]):
                keys.append(key[known])
                items.append(own[known])
            keys, items = np.concatenate(keys), np.concatenate(items)
            order = np.argsort(keys, kind="stable")
            self.classes[k][4], self.classes[k][5] = keys[order], items[order].astype(np.int32)

    def keys(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, which: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each table of the given classes: the keys of all sequences, and which of them hold only known words."""
        s = self.settings
        steps = max(self.classes[k][2] for k in which)
        for walk in range(s.walks):
            at, seen = start.copy(), np.empty((steps, len(start)), dtype=np.int64)
            for j in range(steps):
                now = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], PAD)
                seen[j] = now
                bit = _mix(now.astype(np.uint64) + np.uint64((s.seed + 1_000_003 * (walk * 4096 + j)) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)
                at = at + bit.astype(np.int64)
            for k in which:
                for t, pick in enumerate(self.classes[k][3][walk]):
                    rows = seen[pick]
                    h = np.full(len(start), (walk * s.tables + t) * 64 + self.classes[k][0], dtype=np.uint64)
                    for row in rows:
                        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
                    yield k, h, (rows >= 0).all(axis=0)

    def windows(self, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that can hold an item, and the ends of their documents; ``begin``: where documents begin, and the end of the last."""
        hit = np.zeros(len(flat), dtype=bool)
        for g, keys in self.run_keys.items():
            h = self.grams(flat, g)
            at = np.flatnonzero(self.run_bits[g][(h >> np.uint64(44)).astype(np.int64)])
            at = at[np.isin(h[at], keys)]
            hit[at] = True
        at = np.flatnonzero(hit)
        if not len(at):
            return at, at
        doc = np.searchsorted(begin, at, side="right") - 1
        low = np.maximum(at - self.longest, begin[doc])
        mark = np.zeros(len(flat) + 1, dtype=np.int32)
        np.add.at(mark, low, 1)
        np.add.at(mark, at + 1, -1)
        start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        return start, begin[np.searchsorted(begin, start, side="right")]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, end, edits) of each item found in each text, at its best place."""
        if not self.words or not texts:
            return []
        words, count = [], []
        for text in texts:
            own = WORD.findall(text.lower())
            words += own
            count.append(len(own))
        if not words:
            return []
        flat = np.fromiter(map(self.vocabulary.get, words, repeat(OTHER)), dtype=np.int64, count=len(words))
        begin = ragged.offsets(np.array(count, dtype=np.int64))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        self._find_short(flat, begin, found)
        if self.walked:
            self._find_walked(flat, begin, found)
        return [(d, item, *x) for (d, item), x in sorted(found.items())]

    def _find_walked(self, flat: np.ndarray, begin: np.ndarray, found: dict) -> None:
        """Verify items wherever a window shares a key with one of their pieces."""
        start, end = self.windows(flat, np.unique(begin))
        pairs = []
        for a in range(0, len(start), 20_000):
            s, e = start[a : a + 20_000], end[a : a + 20_000]
            for k, key, whole in self.keys(flat, s, e, list(range(len(self.classes)))):
                keys, items = self.classes[k][4:]
                bits = self.key_bits[k]
                hit = np.flatnonzero(whole & bits[(key >> np.uint64(48)).astype(np.int64)])
                lo, hi = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], side="right")
                if len(hit) and (hi > lo).any():
                    pairs.append(np.stack([np.repeat(s[hit], hi - lo), items[ragged.take(lo, hi - lo)]]))
        if pairs:
            at, piece = np.unique(np.concatenate(pairs, axis=1), axis=1)
            self._verify(flat, begin, np.searchsorted(begin, at, side="right") - 1, at - self.piece_at[piece], self.piece_item[piece], found)

    def _verify(self, flat: np.ndarray, begin: np.ndarray, doc: np.ndarray, place: np.ndarray, owner: np.ndarray, found: dict) -> None:
        """Put (first word, end, edits) of each item ``owner`` at its best place into ``found``, by text and item."""
        order = np.lexsort((place, doc, owner))
        stretch: list[int] | None = None
        for i in [*order.tolist(), None]:
            if i is not None:
                d, item, p = int(doc[i]), int(owner[i]), int(place[i])
                n, k = len(self.words[item]), self.edits[item]
                lo, hi = max(int(begin[d]), p - k), min(int(begin[d + 1]), p + n + 2 * k)
                if stretch and stretch[0] == d and stretch[1] == item and lo <= stretch[3]:
                    stretch[3] = max(hi, stretch[3])
                    continue
            if stretch:
                d0, item0, lo0, hi0 = stretch
                text = flat[lo0:hi0].tolist()
                edits, stop = best_edits(self.words[item0], text)
                if edits <= self.edits[item0] and ((d0, item0) not in found or edits < found[d0, item0][2]):
                    back = best_edits(self.words[item0][::-1], text[:stop][::-1])[1]
                    found[d0, item0] = (lo0 + stop - back - int(begin[d0]), lo0 + stop - int(begin[d0]), edits)
            if i is not None:
                stretch = [d, item, lo, hi]


def _texts(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, t, h, g) of the items that have a text; two hashes stand for the text."""
    use = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("t")).where(F.octet_length("t") > 0)
    return use.withColumns({"h": F.xxhash64("t"), "g": F.xxhash64(F.lit("item"), "t")})


def _sent(text: Column, settings: Settings) -> Column:
    """About the bytes that a text takes in a block, rather more: keys by pieces; runs, numbers and vocabulary by words."""
    words = F.regexp_count(text, F.lit(rf"(?U)[\w&&[^{UNSPACED}]]+|[{UNSPACED}]"))
    pieces = F.ceil((words + 1) / settings.piece_words)
    return pieces * (12 * settings.walks * settings.tables + 100) + 25 * words + F.octet_length(text) + 60


def _blocks(items: DataFrame, settings: Settings) -> tuple[int, Iterator[Items]]:
    """How many blocks there are, and the blocks: different texts, ``block_bytes`` when sent, collected as it is asked for.

    Of several blocks the texts are stored first, dealt by hash into portions of an eighth of a block; a block is as
    many neighbouring portions as fit. The driver sees the sizes of portions."""
    texts = items.groupBy("h", "g").agg(F.first("t").alias("t"))
    size = texts.agg(F.sum(_sent(F.col("t"), settings))).first()[0] or 0
    if size <= settings.block_bytes:
        return int(size > 0), (_block(texts, settings) for _ in range(int(size > 0)))
    portions = -(-8 * size // settings.block_bytes)
    dealt = texts.withColumn("portion", F.pmod(F.xxhash64("h", "g"), F.lit(portions)).cast("int")).repartition("portion").sortWithinPartitions("portion")
    stash = Stash(items.sparkSession)
    dealt, path = stash.save(dealt, "items")
    starts, held = [], 0
    for portion, sent in sorted(map(tuple, dealt.groupBy("portion").agg(F.sum(_sent(F.col("t"), settings))).collect())):
        if not starts or held + sent > settings.block_bytes:
            starts.append(portion)
            held = 0
        held += sent

    def collect() -> Iterator[Items]:
        for a, b in zip(starts, [*starts[1:], portions], strict=True):
            yield _block(dealt.where(F.col("portion").between(a, b - 1)), settings)
        stash.drop(path)

    return len(starts), collect()


def _block(texts: DataFrame, settings: Settings) -> Items:
    rows = sorted((r["t"], r["h"], r["g"]) for r in texts.select("t", "h", "g").collect())
    return Items([(h, g) for _, h, g in rows], [t for t, _, _ in rows], settings)


def _matches(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """The matches of one block in documents (d, t), with the hashes of the items' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for part in ragged.slices(batch, "t"):
                ids = part.column("d").to_pylist()
                rows = [(ids[d], *key, a, b, k, 1 - k / len(items.words[i])) for d, i, a, b, k in items.search(ragged.texts(part, "t")) for key in items.ids[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return docs.mapInArrow(run, _FOUND)


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: where, and with how many edits."""
    spark, stash = docs.sparkSession, Stash(docs.sparkSession)
    use = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    items = _texts(benchmark, item_id, item_text)
    n, blocks = _blocks(items, settings)
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        found = _matches(use, shared)
        if n > 1:
            found, _ = stash.save(found, "matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], MATCHES)
    # Documents that hold a hot item are split by the join; a text's items are few, or else they are rows that are asked for.
    return skew_join(out, items.select("item_id", "h", "g"), ["h", "g"]).select(MATCHES.names)


def remove(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, in which no item is found. One block of items: no shuffle; of several, each leaves the
    two hashes of the texts that hold an item, and the documents without such a text stay."""
    n, blocks = _blocks(_texts(benchmark, item_id, item_text), settings)
    if n == 0:
        return docs
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(blocks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in ragged.slices(batch, text):
                    yield part.filter(pc.invert(_hit(shared.value, part, text)))

        return docs.mapInArrow(run, docs.schema)
    stash, held = Stash(docs.sparkSession), None
    body = F.coalesce(F.col(text), F.lit(""))
    key = [F.xxhash64(body).alias("h"), F.xxhash64(F.lit("text"), body).alias("g")]
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        found, _ = stash.save(_holders(docs.select(*key, body.alias("t")), shared).distinct(), "held")
        shared.destroy()
        held = found if held is None else held.unionByName(found)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    return whole.join(held.distinct(), ["h", "g"], "left_anti").select("row.*")


def _hit(items: Items, part: pa.RecordBatch, text: str) -> pa.Array:
    """Which texts hold an item."""
    hit = np.zeros(part.num_rows, dtype=bool)
    hit[[row[0] for row in items.search(ragged.texts(part, text))]] = True
    return pa.array(hit)


def _holders(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(h, g) of the documents (h, g, t) that hold an item of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "t"):
                yield part.filter(_hit(shared.value, part, "t")).select(["h", "g"])

    return docs.mapInArrow(run, "h long, g long")


_FOUND = T.StructType([MATCHES["doc_id"], T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), *MATCHES.fields[2:]])
_ARROW = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])
