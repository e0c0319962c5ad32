"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words: a cut goes wherever no piece of the vocabulary spans it, so that each word can be
merged on its own and repeated words are merged once. The symbols of all new words lie in one flat numpy
array. A round finds each word's best-ranked pair by a segmented minimum, merges its occurrences from the
left in all words at once, and compacts the array; words in which no pair is left drop out.

The library merges one pair at a time. Several occurrences in one round give the same pieces unless a merge
makes a new pair that is as good as the one at work; a word's round ends with such an occurrence.

Null texts count as empty. An empty text has the end id only, and decodes to an empty text. A text of any length is encoded
whole; one task holds it with its ids. Ties between pairs of equal score go
to the left one. Rows are independent: repeated rows give repeated results, an empty table an empty one, and
columns beyond the text pass through untouched, but for one with an output's name, which the output replaces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import memory, ragged

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int32(2**31 - 1)
#: Words that a Python worker remembers (their letters are bounded too); beyond that it starts anew.
CACHE_WORDS = 200_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """A BPE model file, as tables for the merge rounds."""

    def __init__(self, blob: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(blob):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a BPE model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that add a leading space and change nothing else are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = pieces
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.end = next(i for i, p in enumerate(pieces) if p[0] == "</s>")
        self.byte_ids = np.full(256, self.unknown, dtype=np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        self.has_bytes = any(p[2] == BYTE for p in pieces)
        self._tables()

    def _tables(self) -> None:
        normal = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        symbol = dict(normal)
        for text in normal:  # characters that only occur inside longer pieces
            for c in text:
                symbol.setdefault(c, len(self.pieces) + len(symbol) - len(normal))
        self.n_symbols = max(symbol.values()) + 1
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for text, i in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        by_score = {s: r for r, s in enumerate(sorted({self.pieces[i][1] for i in normal.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for text, i in normal.items():
            for cut in range(1, len(text)):
                a, b = symbol.get(text[:cut]), symbol.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = (by_score[self.pieces[i][1]], i)
        self._hash(np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2))
        inside = {c for text in normal for c in text[1:]}
        after_other = any(text[k] == SPACE != text[k - 1] for text in normal for k in range(1, len(text)))
        in_pieces = inside | {text[0] for text in normal if len(text) > 1}
        if after_other:
            self.words = re.compile(r".+", re.DOTALL)
        elif "\n" in in_pieces:
            self.words = re.compile(f"{SPACE}+[^{SPACE}]*")
        else:
            self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
        spelled = [b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode() for text, _, kind in self.pieces]
        for value in range(256):
            if self.has_bytes:
                spelled[self.byte_ids[value]] = bytes([value])
        self.spelled = spelled
        self.spelled_flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelled_len = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spelled_at = ragged.offsets(self.spelled_len)[:-1]

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of pairs, a quarter full at most."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros((2, 1 << self.bits), dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[slot] == -1
            self.slots[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            placed = self.slots[slot] == keys[left]
            self.values[:, slot[placed]] = values[left[placed]].T
            left, slot = left[~placed], (slot[~placed] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if no piece) and the symbol that it makes."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) * self.n_symbols + right)
        slot = self._slot(key)
        found = self.slots[slot]
        other = np.flatnonzero((found != key) & (found != -1))
        while len(other):
            slot[other] = (slot[other] + 1) & (1 << self.bits) - 1
            found[other] = self.slots[slot[other]]
            other = other[(found[other] != key[other]) & (found[other] != -1)]
        hit = found == key
        return np.where(hit, self.values[0, slot], NONE), np.where(hit, self.values[1, slot], np.int32(-1))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each word."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int64), np.array([len(w) for w in words], dtype=np.int64))
        symbol = self.of_char[chars]
        symbol = np.where(symbol < 0, -1 - chars.astype(np.int32), symbol).astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), NONE, dtype=np.int32)
        if len(symbol) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._pairs(symbol[:-1], symbol[1:])[0], NONE)
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbol)))
            alive = best < NONE
            if not alive.all():
                keep = np.repeat(alive, size)
                done.append((word[~keep], symbol[~keep]))
                word, symbol, rank, best, size = word[keep], symbol[keep], rank[keep], best[alive], size[alive]
                if not len(symbol):
                    break
            best = np.repeat(best, size)
            at = np.flatnonzero(rank == best)
            at = self._disjoint(at)
            symbol, word, rank = self._round(symbol, word, rank, best, at)
        return self._spell(done, len(words))

    @staticmethod
    def _disjoint(at: np.ndarray) -> np.ndarray:
        """Every other one of adjacent occurrences, from the left (in ``aaa`` only the first pair)."""
        new = np.append(True, np.diff(at) != 1)
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - start) % 2 == 0]

    def _round(self, symbol, word, rank, best, at):
        n = len(symbol)
        made = self._pairs(symbol[at], symbol[at + 1])[1]
        nothing = np.int32(-(2**30))
        left = np.where((at > 0) & (word[at - 1] == word[at]), symbol[at - 1], nothing)
        touches = np.append(False, (at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]]))
        left = np.where(touches, np.append(nothing, made[:-1]), left)
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 < n) & (word[after] == word[at]), symbol[after], nothing)
        ends = (self._pairs(left, made)[0] <= best[at]) | (self._pairs(made, right)[0] <= best[at])
        if ends.any():
            before = np.cumsum(ends) - ends
            new = np.append(True, word[at[1:]] != word[at[:-1]])
            base = before[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            stay = before == base
            at, made = at[stay], made[stay]
        symbol = symbol.copy()
        symbol[at] = made
        keep = np.ones(n, dtype=bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbol, word, rank = symbol[keep], word[keep], rank[keep]
        touched = np.zeros(len(symbol) + 1, dtype=bool)
        touched[place[at]] = touched[place[at] - 1] = True  # the pair made and the one before it; -1 is the spare place
        renewed = np.flatnonzero(touched[:-1])
        rank[renewed] = NONE
        renewed = renewed[renewed + 1 < len(symbol)]
        renewed = renewed[word[renewed] == word[renewed + 1]]
        rank[renewed] = self._pairs(symbol[renewed], symbol[renewed + 1])[0]
        return symbol, word, rank

    def _spell(self, done, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become their bytes (or the unknown id); words in order again."""
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(n_words, dtype=np.int64)
        word = np.concatenate([w for w, _ in done])
        symbol = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.pieces)))
        if len(odd):
            count = np.ones(len(symbol), dtype=np.int64)
            extra = {int(i): self.of_char_text(int(symbol[i])) for i in odd}
            ids = {i: self.byte_ids[np.frombuffer(c.encode("utf-8", "surrogatepass"), dtype=np.uint8)] if self.has_bytes else np.array([self.unknown], dtype=np.int32) for i, c in extra.items()}
            for i, x in ids.items():
                count[i] = len(x)
            at = ragged.offsets(count)[:-1]
            out = np.repeat(symbol, count)
            for i, x in ids.items():
                out[at[i] : at[i] + len(x)] = x
            word, symbol = np.repeat(word, count), out
        return symbol, np.bincount(word, minlength=n_words)

    def of_char_text(self, symbol: int) -> str:
        return chr(-1 - symbol) if symbol < 0 else chr(int(np.flatnonzero(self.of_char == symbol)[0]))

    def decode(self, ids: list[int]) -> str:
        """Any ids, as the library decodes them: runs of byte pieces as UTF-8, each wrong byte as U+FFFD."""
        out: list[str] = []
        run = bytearray()
        byte_of = self._byte_of
        begun = False
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                begun = True
                run.clear()
            text, _, kind = self.pieces[i]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            else:
                text = text.replace(SPACE, " ")
                out.append(text[1:] if not begun and text.startswith(" ") else text)
            begun = True
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    @property
    def _byte_of(self) -> dict[int, int]:
        if not hasattr(self, "_bytes"):
            self._bytes = {int(i): b for b, i in enumerate(self.byte_ids)} if self.has_bytes else {}
        return self._bytes


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class Encoder:
    """Encodes and decodes batches of whole texts, with a bounded memory of words."""

    def __init__(self, model: PieceModel, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = model, cache_words
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.ids, self.at, self.n = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        self.total = self.letters = 0

    def _learn(self, new: list[str]) -> None:
        self.letters += sum(map(len, new))
        ids, n = self.model.merge(new)
        self.at.append(self.total + ragged.offsets(n)[:-1])
        self.ids.append(ids)
        self.n.append(n)
        self.total += len(ids)
        self.ids, self.at, self.n = ([np.concatenate(x)] for x in (self.ids, self.at, self.n))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, each text's closed by the end id, and the number of ids of each text."""
        memory.claim(self, self._clear)
        if len(self.seen) > self.cache_words or self.letters > memory.MOST_LETTERS:
            self._clear()
        seen, before, words, count = self.seen, len(self.seen), [], []
        find = self.model.words.findall
        for text in texts:
            own = find(SPACE + text.replace(" ", SPACE)) if text else []
            words += own
            count.append(len(own))
        for w in dict.fromkeys(words):
            if w not in seen:
                seen[w] = len(seen)
        if len(seen) > before:
            new = list(seen)[before:]
            self._learn(new)
        index = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        flat, at, n = self.ids[0], self.at[0], self.n[0]
        n_word = n[index]
        total = np.zeros(len(texts), dtype=np.int64)
        count = np.array(count, dtype=np.int64)
        full = np.flatnonzero(count)
        if len(full):
            total[full] = np.add.reduceat(n_word, ragged.offsets(count)[:-1][full])
        ids = np.full(int(total.sum()) + len(texts), self.model.end, dtype=np.int32)
        ends = np.cumsum(total + 1) - 1
        inner = np.ones(len(ids), dtype=bool)
        inner[ends] = False
        ids[inner] = flat[ragged.take(at[index], n_word)]
        return ids, total + 1

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts of encoded ids; runs of byte pieces are whole characters there, so bytes can be joined."""
        m = self.model
        size = m.spelled_len[ids]
        flat = m.spelled_flat[ragged.take(m.spelled_at[ids], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[ragged.offsets(n)].tolist()
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            try:
                text = flat[a:b].decode()
            except UnicodeDecodeError:
                k = len(out)
                own = ragged.offsets(n)
                text = " " + m.decode(ids[own[k] : own[k + 1]].tolist())
            out.append(text[1:] if text.startswith(" ") else text)
        return out


@lru_cache(2)
def _model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each model in a Python worker, so that its memory of words outlives a task."""
    return Encoder(_model(path))


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of each whole text (end id included) and what they decode to.

    ``model_path`` is a file that every executor has (part of an installed package), or the name of a file
    given to ``SparkContext.addFile``.
    """
    df = df.drop(ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(model_path if "/" in model_path else SparkFiles.get(model_path))
        for batch in batches:
            for part in ragged.slices(batch, text):
                flat, n = codec.encode(ragged.texts(part, text))
                lists = pa.ListArray.from_arrays(pa.array(ragged.offsets(n), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(codec.decode(flat, n), pa.string())], names=[*part.schema.names, ids, decoded])

    return df.mapInArrow(run, schema)
