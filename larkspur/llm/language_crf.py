"""Language identification of words in code-switched text by a linear-chain conditional random field.

Words are runs of letters. A word's emission for each language is the sum of learned weights of its features: the word,
its affixes of 1 to 4 letters, its n-grams of 2 and 3 letters (all hashed), and its place in a learned lexicon (words that are
mostly of one language in the sample). Learned transitions join neighbours. Forward-backward gives every word's
distribution over languages; a document's language is the one with the largest mean over its words, and that mean is the score.

Training maximises the conditional likelihood by stochastic gradient descent (Adagrad steps). Documents tell one
language for all their words, so part of the training sequences is spliced from two documents: that is where
transitions between languages are learned. The sample is bounded: ``sample`` documents of a language outside the held-out
fold (``sample_documents`` of all languages, one of each at least) with ``sample_bytes`` of text in all, in the order of a hash
of id and text. Text and language are all that is learned from; a prediction sees only the text, always whole, however
long. Weights take ``buckets`` numbers for each language.

Forward-backward is exact over whole documents: texts are cut into chunks of ``CHUNK`` words, the chunks' transfer matrices are
multiplied up along each document, and then all chunks of a batch run at once with the messages that arrive at their ends.

A text that is null or has no letter is ``und`` with score 0. Without any labelled document everything is ``und``. Of languages
with equal means the first in the alphabet is predicted. A repeated row counts once in the sample; rows with a null id or
language aren't learned from. Rows are independent: repeated rows have repeated results; an empty table gives an empty result. Other columns pass through,
but for one with an output's name, which the output replaces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import memory, ragged, sampling

WORD = re.compile(r"[^\W\d_]+")
CHUNK, CACHE_WORDS, STEP_BYTES = 128, 300_000, 4_000_000


@dataclass(frozen=True)
class Settings:
    sample: int = 400
    sample_documents: int = 4000
    sample_bytes: int = 24_000_000
    buckets: int = 1 << 17
    length: int = 64
    batch: int = 64
    epochs: int = 3
    spliced: float = 0.3
    rate: float = 0.2
    decay: float = 1e-6
    lexicon_count: int = 3
    lexicon_share: float = 0.6
    seed: int = 5


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def features(word: str, buckets: int) -> list[int]:
    n = len(word)
    own = [f"w{word}"]
    own += [f"p{word[:k]}" for k in range(1, min(4, n) + 1)] + [f"s{word[-k:]}" for k in range(1, min(4, n) + 1)]
    own += [f"n{word[i : i + k]}" for k in (2, 3) for i in range(n - k + 1)]
    return [crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in own]


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    weights: np.ndarray  # (buckets + languages, languages): hashed features, then lexicon features
    transitions: np.ndarray
    lexicon: dict[str, int]
    index: dict[str, int] = field(default_factory=dict, repr=False)
    emissions: np.ndarray | None = field(default=None, repr=False)
    letters: int = field(default=0, repr=False)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of words as ragged rows: flat, and their numbers."""
        flat, size = array("q"), array("q")
        for w in words:
            own = features(w, self.settings.buckets) + ([self.settings.buckets + self.lexicon[w]] if w in self.lexicon else [])
            flat.extend(own)
            size.append(len(own))
        return np.frombuffer(flat, dtype=np.int64) if flat else np.zeros(0, dtype=np.int64), np.array(size, dtype=np.int64)

    def _forget(self) -> None:
        self.index, self.emissions, self.letters = {}, np.zeros((0, len(self.languages))), 0

    def emit(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """exp(emission) of all words, scaled to at most 1, and the words of each text."""
        memory.claim(self, self._forget)
        if self.emissions is None or len(self.index) > CACHE_WORDS or self.letters > memory.MOST_LETTERS:
            self._forget()
        words, n = [], []
        for t in texts:
            own = words_of(t)
            words += own
            n.append(len(own))
        before, index = len(self.index), self.index
        for w in dict.fromkeys(words):
            if w not in index:
                index[w] = len(index)
        if len(index) > before:
            new = list(index)[before:]
            self.letters += sum(map(len, new))
            flat, size = self.rows(new)
            score = np.add.reduceat(self.weights[flat], ragged.offsets(size)[:-1], axis=0)
            score = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))
            self.emissions = np.concatenate([self.emissions, score])
        return self.emissions[np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))], np.array(n, dtype=np.int64)

    def marginals(self, emission: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Forward-backward over whole texts: each word's distribution over languages."""
        k = len(self.languages)
        move = np.exp(self.transitions - self.transitions.max())
        chunks = -(-n // CHUNK)
        doc = np.repeat(np.arange(len(n)), chunks)
        first = ragged.offsets(chunks)[:-1]
        at = np.arange(len(doc)) - first[doc]
        size = np.minimum(CHUNK, n[doc] - at * CHUNK)
        start = ragged.offsets(n)[:-1][doc] + at * CHUNK
        steps = int(size.max()) if len(size) else 0
        # Padding by ones of weight: words beyond a chunk's end are handled by masks.
        whole = np.broadcast_to(np.eye(k), (len(doc), k, k)).copy()
        for t in range(steps):
            on = np.flatnonzero((size > t) & (chunks[doc] > 1))
            x = (whole[on] @ move) * emission[start[on] + t][:, None, :]
            whole[on] = x / x.max(axis=(1, 2), keepdims=True)
        into, back = np.full((len(doc), k), 1.0 / k), np.ones((len(doc), k))
        for c in range(1, int(chunks.max()) if len(chunks) else 0):
            here = np.flatnonzero(at == c)
            x = np.einsum("ni,nij->nj", into[here - 1], whole[here - 1])
            into[here] = x / x.sum(axis=1, keepdims=True)
        left = chunks[doc] - 1 - at
        for c in range(1, int(chunks.max()) if len(chunks) else 0):
            here = np.flatnonzero(left == c)
            x = np.einsum("nij,nj->ni", whole[here + 1], back[here + 1])
            back[here] = x / x.sum(axis=1, keepdims=True)
        out = np.zeros_like(emission)
        message = into
        for t in range(steps):
            on = np.flatnonzero(size > t)
            x = (message[on] @ move) * emission[start[on] + t]
            message[on] = x / x.sum(axis=1, keepdims=True)
            out[start[on] + t] = message[on]
        message = back
        for t in range(steps - 1, -1, -1):
            on = np.flatnonzero(size > t)
            place = start[on] + t
            out[place] *= message[on]
            x = (emission[place] * message[on]) @ move.T
            message[on] = x / x.sum(axis=1, keepdims=True)
        return out / out.sum(axis=1, keepdims=True)

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word with its likeliest language and that one's probability."""
        if not self.languages:
            return []
        emission, n = self.emit([text])
        p = self.marginals(emission, n)
        return [(w, self.languages[int(i)], float(x)) for w, i, x in zip(words_of(text), p.argmax(axis=1), p.max(axis=1), strict=True)]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        emission, n = self.emit(texts)
        doc, p = np.repeat(np.arange(len(n)), n), self.marginals(emission, n)
        mean = np.stack([np.bincount(doc, p[:, y], minlength=len(n)) for y in range(len(self.languages))], axis=1) / np.maximum(1, n)[:, None]
        best = mean.argmax(axis=1)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, np.clip(mean[np.arange(len(n)), best], 0, 1), 0.0)


def _batch_gradient(emission: np.ndarray, gold: np.ndarray, on: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood for padded sequences: by emission (b, t, k) and by transition."""
    b, steps, k = emission.shape
    move = np.exp(transitions)
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    forward = np.empty((steps, b, k))
    message = np.full((b, k), 1.0 / k)
    for t in range(steps):
        x = (message @ move) * e[:, t]
        x /= x.sum(axis=1, keepdims=True)
        message = np.where(on[:, t, None], x, message)
        forward[t] = message
    message = np.ones((b, k))
    grad, grad_move = np.zeros_like(emission), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        live = on[:, t]
        p = forward[t] * message
        p /= p.sum(axis=1, keepdims=True)
        grad[:, t] = p * live[:, None]
        x = e[:, t] * message
        if t:
            pair = forward[t - 1][:, :, None] * move[None] * x[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            grad_move += pair[live].sum(axis=0)
        x = x @ move.T
        message = np.where(live[:, None], x / x.sum(axis=1, keepdims=True), message)
    rows, cols = np.nonzero(on)
    grad[rows, cols, gold[rows, cols]] -= 1
    both = on[:, 1:] & on[:, :-1]
    np.add.at(grad_move, (gold[:, :-1][both], gold[:, 1:][both]), -1)
    return grad, grad_move


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Learn feature weights, lexicon and transitions from texts of one language each."""
    rng = np.random.default_rng(settings.seed)
    languages = sorted(set(labels))
    docs = [(words_of(t), languages.index(y)) for t, y in zip(texts, labels, strict=True)]
    docs = [(w, y) for w, y in docs if w]
    k = len(languages)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int64) for ws, _ in docs]
    seen = np.zeros((len(vocabulary), max(1, k)))
    for ids, (_, y) in zip(coded, docs, strict=True):
        seen[:, y] += np.bincount(ids, minlength=len(vocabulary))
    size = seen.sum(axis=0)
    rate = seen / np.maximum(1, size)
    share = rate / np.maximum(1e-12, rate.sum(axis=1, keepdims=True))
    words = list(vocabulary)
    lexicon = {words[i]: int(share[i].argmax()) for i in np.flatnonzero((seen.sum(axis=1) >= settings.lexicon_count) & (share.max(axis=1) >= settings.lexicon_share))} if k else {}
    model = Model(settings, languages, np.zeros((settings.buckets + k, k)), np.zeros((k, k)), lexicon)
    if k < 2:
        return model
    flat, count = model.rows(words)
    at = ragged.offsets(count)[:-1]
    pieces = [(ids[a : a + settings.length], y) for ids, (_, y) in zip(coded, docs, strict=True) for a in range(0, len(ids), settings.length)]
    seen_w, seen_t = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    for _ in range(settings.epochs):
        order = rng.permutation(len(pieces))
        for a in range(0, len(order), settings.batch):
            chosen = [pieces[i] for i in order[a : a + settings.batch]]
            ids = np.zeros((len(chosen), settings.length), dtype=np.int64)
            gold, on = np.zeros_like(ids), np.zeros(ids.shape, dtype=bool)
            for r, (w, y) in enumerate(chosen):
                if rng.random() < settings.spliced:
                    other, z = pieces[rng.integers(len(pieces))]
                    cut = int(rng.integers(1, len(w) + 1))
                    tail = other[: settings.length - cut]
                    w, ys = np.concatenate([w[:cut], tail]), np.append(np.full(cut, y), np.full(len(tail), z))
                else:
                    ys = np.full(len(w), y)
                ids[r, : len(w)], gold[r, : len(w)], on[r, : len(w)] = w, ys, True
            kinds, inverse = np.unique(ids[on], return_inverse=True)
            rows = flat[ragged.take(at[kinds], count[kinds])]
            score = np.add.reduceat(model.weights[rows], ragged.offsets(count[kinds])[:-1], axis=0)
            emission = np.zeros((*ids.shape, k))
            emission[on] = score[inverse]
            grad, grad_move = _batch_gradient(emission, gold, on, model.transitions)
            by_kind = np.stack([np.bincount(inverse, grad[on][:, y], minlength=len(kinds)) for y in range(k)], axis=1) / len(chosen)
            keys, where = np.unique(rows, return_inverse=True)
            owner = np.repeat(np.arange(len(kinds)), count[kinds])
            by_key = np.stack([np.bincount(where, by_kind[owner, y], minlength=len(keys)) for y in range(k)], axis=1) + settings.decay * model.weights[keys]
            seen_w[keys] += by_key**2
            model.weights[keys] -= settings.rate * by_key / np.sqrt(seen_w[keys])
            grad_move /= len(chosen)
            seen_t += grad_move**2
            model.transitions = model.transitions - settings.rate * grad_move / np.sqrt(seen_t)
    return model


def train(docs: DataFrame, settings: Settings = Settings(), lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on about ``settings.sample`` documents of each language, fewer where that would be over ``sample_documents`` in all, and one at least."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~sampling.held_out(F.col(doc_id)))
    usable = usable.select(F.col(doc_id).alias("_d"), F.col(lang).alias("_y"), F.col(text).alias("_t"))
    place = F.shiftrightunsigned(sampling.order(F.col("_d"), F.xxhash64("_t")), 11) / F.lit(2.0**53)
    # Different places, not rows: a row that is repeated very often takes no more of the sample than any other.
    counts = usable.groupBy("_y").agg(F.approx_count_distinct(place, 0.02).alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "_y").collect()
    if not counts:
        return fit([], [], settings)
    # A language's share of the hash range that holds about ``sample`` of its documents: no ranking within a language.
    most = min(settings.sample, settings.sample_documents / len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["_y"], max(r["first"], min(1.0, most / r["n"])))])
    chosen = usable.where(place <= F.try_element_at(share, F.col("_y")))
    found = sampling.labelled_texts(chosen, 2 * settings.sample_documents + len(counts), settings.sample_bytes)
    return fit([t for _, t in found], [y for y, _ in found], settings)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in ragged.slices(batch, text, STEP_BYTES):
                lang, p = own.predict(ragged.texts(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
