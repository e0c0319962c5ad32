"""Word-piece counts by a linear longest-match automaton.

The vocabulary's trie has two roots, one for pieces that begin a word and one for those that continue it. Every
node has a failure link and the number of pieces that following the link pops: what greedy longest-match
would have cut off by then. A word's pieces are counted in one pass over its characters, without building
any piece; the steps over a batch's new words are taken in all words at once, those of words of over ``LONG_WORD`` letters
one by one.

The pieces come from a SentencePiece vocabulary: with the word mark a piece begins a word, without it it
continues one. A word that can't be cut into pieces is one unknown token, as in word-piece tokenizers. Words
are separated by ASCII white space. Null and empty texts have no words. Texts and words of any length are counted whole. Greedy
cuts leave no ties. Rows are independent: repeated rows
give repeated results; other columns pass through, but for one with an output's name, which the output replaces.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm import memory, ragged
from larkspur.llm.sentencepiece_codec import NORMAL, SPACE, PieceModel

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CACHE_WORDS, LONG_WORD = 300_000, 1000
START, CONTINUE, FAILED = 0, 1, -1


class Automaton:
    """Trie, failure links and popped-piece counts of a word-piece vocabulary."""

    def __init__(self, first: Iterable[str], following: Iterable[str]):
        children: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((START, first), (CONTINUE, following)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                        ends.append(False)
                    node = children[node][c]
                ends[node] = ends[node] or node != root
        fail, pops = [FAILED] * len(children), [0] * len(children)
        queue = deque([START, CONTINUE])
        while queue:
            node = queue.popleft()
            for c, child in children[node].items():
                queue.append(child)
                if ends[child]:
                    fail[child], pops[child] = CONTINUE, 1
                    continue
                z, popped = fail[node], pops[node]
                while z != FAILED and c not in children[z]:
                    popped += pops[z]
                    z = fail[z]
                if z != FAILED:
                    fail[child], pops[child] = children[z][c], popped
        self.fail, self.pops = np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32)
        alphabet = sorted({c for x in children for c in x})
        self.of_char = np.zeros(0x110000, dtype=np.int32)
        self.of_char[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        edges = sorted((node * self.width + int(self.of_char[ord(c)]), child) for node, x in enumerate(children) for c, child in x.items())
        self.keys = np.array([k for k, _ in edges] + [2**62], dtype=np.int64)
        self.targets = np.array([t for _, t in edges] + [FAILED], dtype=np.int32)
        self.edges: dict[int, int] | None = None

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + char
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.targets[at], FAILED)

    def count_long(self, word: str) -> int:
        """Pieces of one word, a step for each letter."""
        if self.edges is None:
            self.edges = dict(zip(self.keys[:-1].tolist(), self.targets[:-1].tolist(), strict=True))
        fail, pops, state, found = self.fail, self.pops, START, 0
        for char in self.of_char[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tolist():
            while (after := self.edges.get(state * self.width + char)) is None:
                if fail[state] == FAILED:
                    return 0
                found, state = found + int(pops[state]), int(fail[state])
            state = after
        while state != CONTINUE:
            if fail[state] == FAILED:
                return 0
            found, state = found + int(pops[state]), int(fail[state])
        return found

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word; 0 for a word that can't be cut."""
        short = [w for w in words if len(w) <= LONG_WORD]
        if len(short) < len(words):
            of_short = iter(self.count(short).tolist())
            return np.array([next(of_short) if len(w) <= LONG_WORD else self.count_long(w) for w in words], dtype=np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        chars = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        at = ragged.offsets(np.array([len(w) for w in words], dtype=np.int64))[:-1][order]
        state, found = np.zeros(len(words), dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        alive = np.ones(len(words), dtype=bool)
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # longest first: those longer than t
            go = np.flatnonzero(alive[:n])
            char = chars[at[go] + t]
            while len(go):
                after = self._step(state[go], char)
                hit = after != FAILED
                state[go[hit]] = after[hit]
                go, char = go[~hit], char[~hit]
                dead = self.fail[state[go]] == FAILED
                alive[go[dead]] = False
                go, char = go[~dead], char[~dead]
                found[go] += self.pops[state[go]]
                state[go] = self.fail[state[go]]
        go = np.flatnonzero(alive)
        while len(go := go[state[go] != CONTINUE]):
            dead = self.fail[state[go]] == FAILED
            alive[go[dead]] = False
            go = go[~dead]
            found[go] += self.pops[state[go]]
            state[go] = self.fail[state[go]]
        out = np.zeros(len(words), dtype=np.int64)
        out[order] = np.where(alive, found, 0)
        return out


def pieces(model: PieceModel) -> tuple[list[str], list[str]]:
    """The vocabulary's pieces that begin a word, without the mark, and those that continue one."""
    texts = [text for text, _, kind in model.pieces if kind == NORMAL]
    return [x[1:] for x in texts if x[0] == SPACE and x.count(SPACE) == 1 and len(x) > 1], [x for x in texts if SPACE not in x]


class Counter:
    """Counts of whole texts, with a bounded memory of words."""

    def __init__(self, automaton: Automaton, cache_words: int = CACHE_WORDS):
        self.automaton, self.cache_words = automaton, cache_words
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.counts, self.letters = np.zeros(0, dtype=np.int64), 0

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and unknown words of each text."""
        memory.claim(self, self._clear)
        if len(self.seen) > self.cache_words or self.letters > memory.MOST_LETTERS:
            self._clear()
        before, words, n = len(self.seen), [], []
        for text in texts:
            own = WORD.findall(text)
            words += own
            n.append(len(own))
        for w in dict.fromkeys(words):
            if w not in self.seen:
                self.seen[w] = len(self.seen)
        if len(self.seen) > before:
            new = list(self.seen)[before:]
            self.letters += sum(map(len, new))
            self.counts = np.concatenate([self.counts, self.automaton.count(new)])
        found = self.counts[np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))]
        n = np.array(n, dtype=np.int64)
        at = ragged.offsets(n)
        tokens, unknown = (np.append(0, np.cumsum(x)) for x in (np.maximum(found, 1), found == 0))
        return n, tokens[at[1:]] - tokens[at[:-1]], unknown[at[1:]] - unknown[at[:-1]]


@lru_cache(2)
def counter(path: str) -> Counter:
    with open(path, "rb") as f:
        return Counter(Automaton(*pieces(PieceModel(f.read()))))


def count_tokens(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Add n_words, n_tokens and n_unknown of each whole text."""
    added = ["n_words", "n_tokens", "n_unknown"]
    df = df.drop(*added)
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType(), False) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary_path)
        for batch in batches:
            for part in ragged.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, pa.int64()) for x in own.count(ragged.texts(part, text))]], names=[*part.schema.names, *added])

    return df.mapInArrow(run, schema)
