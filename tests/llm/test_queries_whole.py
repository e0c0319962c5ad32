"""Each registered query that SQL can't express, over the whole small tables, against brute force or a library."""

from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from test_classifiers import brute_score
from test_pair_operators import brute_classes, closure
from tokenizers import Tokenizer, models

from larkspur.llm import decontamination, language_crf, ngram_join, quality_classifier, queries, sharding, token_counts
from larkspur.llm.sentencepiece_codec import PieceModel


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_op4_finds_what_edit_distance_finds(spark, sf_dir, texts):
    coded = lambda t, ids: [ids.setdefault(w, len(ids)) for w in decontamination.WORD.findall((t or "").lower())]
    ids: dict[str, int] = {}
    docs = [(d, coded(t, ids)) for d, t in texts]
    items = [(r["item_id"], coded(r["text"], ids)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for d, words in docs:
        there = set(words)
        for i, item in items:
            k = int(0.2 * len(item) + 1e-9)
            if item and sum(w not in there for w in item) <= k and (e := decontamination.best_edits(item, words)[0]) <= k:
                want.add((d, i, e))
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in queries.op4_decontamination(spark, sf_dir).collect()}
    assert found == want and len(want) >= 3


def test_op5_equals_the_plain_recursion(spark, sf_dir, texts):
    model = language_crf.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    move, k, of = np.exp(model.transitions), len(model.languages), dict(texts)
    for r in queries.op5_language_crf(spark, sf_dir).collect():
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1)
        words = language_crf.words_of(of[r["doc_id"]] or "")
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        flat, size = model.rows(words)
        emission = np.array([model.weights[flat[e - n : e]].sum(axis=0) for e, n in zip(np.cumsum(size), size, strict=True)])
        emission = np.exp(np.maximum(emission - emission.max(axis=1, keepdims=True), -30))
        forward, message = [], np.full(k, 1 / k)
        for e in emission:
            message = (message @ move) * e
            forward.append(message := message / message.sum())
        back, mean = np.ones(k), np.zeros(k)
        for f, e in zip(reversed(forward), emission[::-1], strict=True):
            p = f * back
            mean += p / p.sum()
            back = move @ (e * back)
            back /= back.sum()
        mean /= len(words)
        assert r["lang_pred"] == model.languages[int(mean.argmax())] and abs(r["score"] - mean.max()) < 1e-8


def test_op6_equals_the_sum_of_its_features(spark, sf_dir, texts):
    model = quality_classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    short = {d: t for d, t in texts if len(t or "") < 20_000}
    rows = {r["doc_id"]: r for r in queries.op6_quality_classifier(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for d, r in rows.items():
        assert r["held_out"] == (crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5)
        if d in short:
            assert abs(r["score"] - brute_score(model, short[d] or "")) < 1e-9


def test_op7_equals_all_cosines(spark, sf_dir):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ok = [k for k, (_, v) in enumerate(table) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([table[k][1] for k in ok], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    roots = closure([table[k][0] for k in ok], [(table[ok[a]][0], table[ok[b]][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    links = {table[k][0]: int(n) for k, n in zip(ok, near.sum(axis=1), strict=True)}
    want = sorted((d, links.get(d, 0), roots.get(d, d), roots.get(d, d) == d) for d, _ in table)
    assert sorted(map(tuple, queries.op7_embedding_dedup(spark, sf_dir).collect())) == want


def test_op8_equals_the_permutation_of_sorted_rows(spark, sf_dir, texts):
    rows = sorted((d, crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t in texts)
    feistel = sharding.Feistel(len(rows), 1729)
    want = sorted((d, size, crc, "rows", *feistel.place(k, 24), None) for k, (d, crc, size) in enumerate(rows))
    assert sorted(map(tuple, queries.op8_sharding(spark, sf_dir).collect())) == want


def test_op9_equals_all_pairs(spark, sf_dir, texts):
    found = queries.op9_ngram_join(spark, sf_dir)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == brute_classes(texts, ngram_join.Join(3, 90, 100))


def test_op10_equals_the_library(spark, sf_dir, texts):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        first, following = token_counts.pieces(PieceModel(f.read()))
    vocabulary = {"[UNK]": 0}
    for p in [*first, *(f"##{x}" for x in following)]:
        vocabulary.setdefault(p, len(vocabulary))
    greedy = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**7)).model
    seen: dict[str, tuple[int, bool]] = {}

    def count(word):
        if word not in seen:
            tokens = [t.value for t in greedy.tokenize(word)]
            seen[word] = len(tokens), tokens == ["[UNK]"]
        return seen[word]

    want = []
    for d, t in texts:
        own = [count(w) for w in token_counts.WORD.findall(t or "")]
        want.append((d, len(own), sum(n for n, _ in own), sum(u for _, u in own)))
    rows = queries.op10_token_counts(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in rows) == sorted(want)
