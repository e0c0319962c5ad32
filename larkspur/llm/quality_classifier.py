"""Quality classifier: supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words, and its repetitions. A word is the mean of the vectors of its
hashed self and of its hashed character n-grams; a pair of words has a hashed vector of its own; a word that came a few words
earlier already counts as "the same as d words ago". The document's vector is the mean over its features, and a
softmax over two learned rows of weights gives the classes. Vectors, weights and biases are learned together by
stochastic gradient descent on the log-likelihood (Adagrad steps, one for each component) in numpy.

Fitting takes a bounded sample: ``sample`` labelled rows outside the held-out fold with ``sample_bytes`` of text in all,
in the order of a hash. Texts in the sample are used whole, and scoring always takes whole texts, however long. As the
logits are linear in the features, a word's part in them is computed once for each worker.

Null and empty texts have no words and score by the biases alone. A document whose label is null isn't learned from; of several
labels for one document each counts as a row, repeated rows count once in the sample. Any label but 1 is class 0. Null ids are
scored but not learned from. Without labels every score is 0.5; a score of exactly 0.5 is predicted as 1.
Rows are independent: repeated rows have repeated scores; an empty table gives an empty result. Other columns pass through,
but for one with an output's name, which the output replaces.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import memory, ragged, sampling

CACHE_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    sample: int = 3000
    sample_bytes: int = 24_000_000
    buckets: int = 1 << 18
    width: int = 8
    back: int = 8
    epochs: int = 4
    batch: int = 32
    rate: float = 0.1
    seed: int = 11


def word_hash(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"), 3)


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of a word: itself, and the n-grams of 3 and 4 bytes of the word with its ends marked."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    n = len(w)
    grams = {w[i : i + k] for k in (3, 4) for i in range(n - k + 1)}
    return [crc32(word.encode("utf-8", "surrogatepass"), 1) % buckets, *[crc32(g, 2) % buckets for g in grams]]


class Words:
    """Word types seen so far, with their hashes."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.letters = 0

    def flatten(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Word types of all texts, flat; words in each text; the types that are new."""
        words, n = [], []
        for t in texts:
            own = t.split()
            words += own
            n.append(len(own))
        before, index = len(self.index), self.index
        for w in dict.fromkeys(words):
            if w not in index:
                index[w] = len(index)
        new = list(index)[before:] if len(index) > before else []
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(word_hash, new), dtype=np.uint64, count=len(new))])
            self.letters += sum(map(len, new))
        return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)), np.array(n, dtype=np.int64), new


def subword_rows(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of many words as ragged rows: flat, and their numbers."""
    flat, size = array("q"), array("q")
    for w in words:
        own = subwords(w, buckets)
        flat.extend(own)
        size.append(len(own))
    return np.frombuffer(flat, dtype=np.int64) if flat else np.zeros(0, dtype=np.int64), np.array(size, dtype=np.int64)


def word_pairs(hashes: np.ndarray, n: np.ndarray, buckets: int) -> np.ndarray:
    """For each word the bucket of the pair that it makes with the next word of its text; -1 at a text's end."""
    out = np.full(len(hashes), -1, dtype=np.int64)
    if len(hashes) > 1:
        mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        out[:-1] = ((mixed ^ mixed >> np.uint64(31)) % np.uint64(buckets)).astype(np.int64)
    out[(np.cumsum(n) - 1)[n > 0]] = -1
    return out


def back_references(types: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """For each word how many words before the same word came, up to ``most``; 0 for none. Words in the order of the texts."""
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros(len(types), dtype=np.int64)
    for d in range(most, 0, -1):
        if len(types) > d:
            out[d:][(types[d:] == types[:-d]) & (doc[d:] == doc[:-d])] = d
    return out


class Scorer:
    """What scoring needs of a model: each vector's part in the difference of the two logits, and that of the biases."""

    def __init__(self, settings: Settings, parts: np.ndarray, bias: float):
        self.settings, self.parts, self.bias = settings, parts, bias
        self._forget()

    def _forget(self) -> None:
        self.words, self.shares = Words(), np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1 for each whole text."""
        memory.claim(self, self._forget)
        if len(self.words.index) > CACHE_WORDS or self.words.letters > memory.MOST_LETTERS:
            self._forget()
        s = self.settings
        types, n, new = self.words.flatten(texts)
        if new:
            flat, size = subword_rows(new, s.buckets)
            self.shares = np.concatenate([self.shares, np.add.reduceat(self.parts[flat], ragged.offsets(size)[:-1]) / size])
        back, pair = back_references(types, n, s.back), word_pairs(self.words.hashes[types], n, s.buckets)
        value = self.shares[types] + np.where(back > 0, self.parts[s.buckets + back - 1], 0.0) + np.where(pair >= 0, self.parts[pair], 0.0)
        doc = np.repeat(np.arange(len(n)), n)  # sums of their own: what stands beside a text changes no digit of its score
        total, count = (np.bincount(doc, x, minlength=len(n)) for x in (value, 1 + (back > 0) + (pair >= 0)))
        return 1 / (1 + np.exp(-(self.bias + total / np.maximum(1, count))))


@dataclass
class Model:
    settings: Settings
    vectors: np.ndarray  # of the hashed words, n-grams and pairs, and after them of the repetitions
    weights: np.ndarray  # two rows, from a document's vector to the logits
    bias: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self.settings, self.vectors @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0]))

    def score(self, texts: list[str]) -> np.ndarray:
        return self.scorer().score(texts)


def fit(texts: list[str], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Learn vectors, the two rows of weights and the biases from labelled texts."""
    s, rng = settings, np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (s.buckets + s.back, s.width))
    weights, bias = np.zeros((2, s.width)), np.zeros(2)
    gold = (np.asarray(labels) == 1).astype(np.int64)
    if not len(gold) or gold.min() == gold.max():
        if len(gold):
            bias[1] = np.log((gold.sum() + 0.5) / (len(gold) - gold.sum() + 0.5))
        return Model(s, vectors, weights, bias)
    words = Words()
    parts = [words.flatten(texts[a : a + 100])[:2] for a in range(0, len(texts), 100)]  # few words in memory at a time
    types, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    flat, size = subword_rows(list(words.index), s.buckets)
    at = ragged.offsets(size)[:-1]
    back, pairs = back_references(types, n, s.back), word_pairs(words.hashes[types], n, s.buckets)
    features = n + np.diff(np.append(0, np.cumsum((back > 0).astype(np.int64) + (pairs >= 0)))[ragged.offsets(n)])
    start = ragged.offsets(n)
    touched, number = np.zeros(len(vectors), dtype=bool), np.zeros(len(vectors), dtype=np.int64)
    seen_v, seen_w, seen_b = np.full(vectors.shape, 1e-8), np.full(weights.shape, 1e-8), np.full(2, 1e-8)
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), s.batch):
            docs = order[a : a + s.batch]
            place = ragged.take(start[docs], n[docs])
            doc = np.repeat(np.arange(len(docs)), n[docs])
            total = np.maximum(1, features[docs])
            # (document, type) with its share of the mean, then down to the buckets
            kind, count = np.unique(doc * len(size) + types[place], return_counts=True)
            of, which = kind // len(size), kind % len(size)
            again, two = back[place] > 0, pairs[place] >= 0
            bucket = np.concatenate([flat[ragged.take(at[which], size[which])], s.buckets + back[place][again] - 1, pairs[place][two]])
            owner = np.concatenate([np.repeat(of, size[which]), doc[again], doc[two]])
            share = np.concatenate([np.repeat(count / size[which] / total[of], size[which]), 1 / total[doc[again]], 1 / total[doc[two]]])
            touched[bucket] = True
            key = np.flatnonzero(touched)
            touched[key], number[key] = False, np.arange(len(key))
            inverse = number[bucket]
            own = vectors[key]
            mean = np.stack([np.bincount(owner, share * own[inverse, k], minlength=len(docs)) for k in range(s.width)], axis=1)
            logit = mean @ weights.T + bias
            error = np.exp(logit - logit.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(docs)), gold[docs]] -= 1
            error /= len(docs)
            grad_v = np.stack([np.bincount(inverse, share * error[owner, c], minlength=len(key)) for c in (0, 1)], axis=1) @ weights
            grad_w, grad_b = error.T @ mean, error.sum(axis=0)
            for values, where, grad, seen in ((vectors, key, grad_v, seen_v), (weights, slice(None), grad_w, seen_w), (bias, slice(None), grad_b, seen_b)):
                seen[where] += grad**2
                values[where] -= s.rate * grad / np.sqrt(seen[where])
    return Model(s, vectors, weights, bias)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the bounded sample. Only ids of sampled labels meet the documents (``settings.sample`` rows, broadcast)."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~sampling.held_out(F.col(doc_id)))
    chosen = sampling.first_by_hash(usable.select(F.col(doc_id).alias("_d"), F.col(label).cast("int").alias("_y")).distinct(), "_d", settings.sample)
    rows = docs.select(F.col(doc_id).alias("_d"), F.coalesce(text, F.lit("")).alias("_t")).join(F.broadcast(chosen), "_d")
    found = sampling.labelled_texts(rows, settings.sample, settings.sample_bytes)
    return fit([t for _, t in found], np.array([y for y, _ in found]), settings)


def score(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Add ``score``, the probability of class 1, and ``predicted``."""
    docs = docs.drop(score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType(), False), T.StructField(predicted, T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in ragged.slices(batch, text):
                p = own.score(ragged.texts(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, score, predicted])

    return docs.mapInArrow(run, schema)
