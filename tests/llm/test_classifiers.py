"""Language and quality: brute force for what is computed, held-out accuracy for what is learned, and bounded samples."""

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import language_crf, memory, quality_classifier, queries, sampling

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    import os

    if not os.path.isdir(TABLES):
        pytest.skip("no test data here")
    return TABLES


def brute_score(model, text):
    """The probability of class 1, feature by feature."""
    s, words, features = model.settings, text.split(), []
    for i, w in enumerate(words):
        features.append(np.mean([model.vectors[b] for b in quality_classifier.subwords(w, s.buckets)], axis=0))
        near = [d for d in range(1, s.back + 1) if i >= d and words[i - d] == w]
        if near:
            features.append(model.vectors[s.buckets + min(near) - 1])
        if i + 1 < len(words):
            a, b = (crc32(x.encode(), 3) for x in words[i : i + 2])
            mixed = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) % 2**64
            features.append(model.vectors[(mixed ^ mixed >> 31) % s.buckets])
    logit = (np.mean(features, axis=0) if features else np.zeros(s.width)) @ model.weights.T + model.bias
    return float(np.exp(logit[1]) / np.exp(logit).sum())


def some_texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "ga", "é", "delta-9", "日本"]
    return ["", " \n", "one", "same same same", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]]


def test_scores_equal_brute_force():
    texts = some_texts()
    labels = np.array(["alpha beta" in t for t in texts]).astype(int)
    model = quality_classifier.fit(texts, labels, quality_classifier.Settings(buckets=512, epochs=3))
    assert np.abs(model.score(texts) - [brute_score(model, t) for t in texts]).max() < 1e-9
    assert np.linalg.matrix_rank(model.vectors) == model.settings.width and model.weights.shape == (2, model.settings.width)


def test_a_step_follows_the_gradient(monkeypatch):
    """After one step each component of every vector has moved against its own derivative of the mean loss."""
    texts, labels = ["alpha beta", "beta gamma gamma", "alpha"], np.array([1, 0, 1])
    settings = quality_classifier.Settings(buckets=64, width=3, back=2, batch=3, epochs=2, rate=1e-3)
    before = quality_classifier.fit(texts, labels, quality_classifier.Settings(**{**settings.__dict__, "epochs": 1}))
    after = quality_classifier.fit(texts, labels, settings)

    def loss(vectors):
        model = quality_classifier.Model(settings, vectors, before.weights, before.bias)
        p = [brute_score(model, t) for t in texts]
        return -np.mean([np.log(q if y else 1 - q) for q, y in zip(p, labels, strict=True)])

    for row, k in [(r, k) for r in range(len(before.vectors)) for k in range(3)]:
        step = after.vectors[row, k] - before.vectors[row, k]
        up, down = before.vectors.copy(), before.vectors.copy()
        up[row, k] += 1e-5
        down[row, k] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert (abs(slope) < 1e-9 and step == 0) or step * slope < 0


def test_pairs_of_words_are_learned():
    """The same words in another order: only the pairs tell."""
    rng = random.Random(1)
    good, bad = (lambda: "red fox"), (lambda: "fox red")
    rows = [(" ".join(x() + " stop" for _ in range(rng.randint(1, 4))), y) for _ in range(60) for x, y in ((good, 1), (bad, 0))]
    model = quality_classifier.fit([t for t, _ in rows], np.array([y for _, y in rows]), quality_classifier.Settings(epochs=8))
    assert model.score(["red fox stop"])[0] > 0.7 > 0.3 > model.score(["fox red stop"])[0]


def test_forgetting_words_changes_no_score(monkeypatch):
    texts = some_texts()
    model = quality_classifier.fit(texts, np.arange(len(texts)) % 2, quality_classifier.Settings(buckets=512, epochs=1))
    scorer, want = model.scorer(), model.score(texts)
    monkeypatch.setattr(memory, "MOST_LETTERS", 20)
    assert np.allclose([scorer.score([t])[0] for t in texts], want) and scorer.words.letters < 20 + max(map(len, texts))


def test_languages_equal_brute_force(spark):
    """Predictions of the query's operator against sums over all label sequences."""
    import itertools

    rng = random.Random(5)
    kinds = {"aa": ["ka", "kali", "oki"], "bb": ["sh", "shest", "posh"], "cc": ["ul", "ulum", "dul"]}
    texts = [(" ".join(rng.choices(w, k=rng.randint(1, 5))), k) for k, w in kinds.items() for _ in range(20)] + [("ka posh ulum", "aa"), ("1 2", "aa"), ("", "bb")]
    model = language_crf.fit([t for t, _ in texts], [y for _, y in texts], language_crf.Settings(buckets=256))
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    for r in language_crf.identify(rows, model).collect():
        words = language_crf.words_of(r["text"] or "")
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        flat, size = model.rows(words)
        ends = np.cumsum(size)
        emission = [model.weights[flat[e - n : e]].sum(axis=0) for e, n in zip(ends, size, strict=True)]
        weight = {}
        for labels in itertools.product(range(3), repeat=len(words)):
            # The chain begins from a uniform state, so the first word has a transition too.
            first = np.log(np.exp(model.transitions[:, labels[0]]).sum() / 3)
            weight[labels] = np.exp(first + sum(emission[t][y] for t, y in enumerate(labels)) + sum(model.transitions[a, b] for a, b in zip(labels, labels[1:], strict=False)))
        mean = [sum(w * labels.count(y) for labels, w in weight.items()) / sum(weight.values()) / len(words) for y in range(3)]
        assert r["lang_pred"] == model.languages[int(np.argmax(mean))] and abs(r["score"] - max(mean)) < 1e-9


def test_languages_of_the_held_out_fold(spark, tables):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op5_language_crf(spark, tables).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    ok = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")]
    assert len(ok) > 200 and np.mean(ok) >= 0.99


def test_quality_of_the_held_out_fold(spark, tables):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = queries.op6_quality_classifier(spark, tables).collect()
    assert len(rows) == spark.read.parquet(f"{tables}/documents.parquet").count() and all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    ok = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(ok) > 80 and np.mean(ok) >= 0.97


def test_scores_see_nothing_but_the_text(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model, lang = quality_classifier.train(docs, labels), language_crf.train(docs)
    other = docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("s").alias("source")).repartition(3)
    for score in (lambda d: quality_classifier.score(d, model).select("doc_id", "score"), lambda d: language_crf.identify(d, lang).select("doc_id", "lang_pred", "score")):
        one, two = sorted((r[0], *r[1:]) for r in score(docs).collect()), sorted((-r[0], *r[1:]) for r in score(other).collect())
        assert [r[:-1] for r in one] == [r[:-1] for r in two] and np.allclose([r[-1] for r in one], [r[-1] for r in two], rtol=0, atol=1e-9)


def test_held_out_labels_teach_nothing(spark):
    rows = [(k, f"word{k % 7} text") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("aa"))
    held = sampling.held_out(F.col("doc_id"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    settings = quality_classifier.Settings(buckets=256, epochs=1)
    assert (quality_classifier.train(docs, labels, settings).vectors == quality_classifier.train(docs, flipped, settings).vectors).all()
    assert language_crf.train(docs.withColumn("lang", F.when(held, "bb").otherwise("aa")), language_crf.Settings(buckets=256)).languages == ["aa"]


def test_samples_are_bounded_whatever_is_repeated(spark):
    """One id has half of the rows, one row is repeated very often, and one text is over the bound on bytes."""
    rows = [(1, 0, f"text {k}") for k in range(300)] + [(2, 1, "again")] * 300 + [(k, k % 2, f"own {k}") for k in range(3, 40)] + [(50, 1, "x" * 5000)]
    table = spark.createDataFrame(rows, "_d long, _y int, _t string")
    found = sampling.labelled_texts(table.repartition(5), 100, 4000)
    assert found == sampling.labelled_texts(table.repartition(2), 100, 4000)
    assert len(found) <= 100 and sum(len(t) for _, t in found) <= 4000 and len(found) == len(set(found))
    assert sampling.labelled_texts(table.limit(0), 100, 4000) == []
    docs = table.select(F.col("_d").alias("doc_id"), F.col("_y").cast("string").alias("lang"), F.col("_t").alias("text"))
    assert language_crf.train(docs, language_crf.Settings(sample=20, sample_documents=40, buckets=256, epochs=1)).languages == ["0", "1"]


def test_several_labels_of_one_document_at_the_bound(spark):
    labels = spark.createDataFrame([(k, y) for k in range(40) for y in (0, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "doc_id long, text string")
    settings = quality_classifier.Settings(sample=7, buckets=128, epochs=1)
    models = [quality_classifier.train(docs.repartition(n), labels.repartition(n), settings) for n in (1, 4)]
    assert (models[0].vectors == models[1].vectors).all()


def test_ties(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string")
    even = quality_classifier.Model(quality_classifier.Settings(buckets=16), np.zeros((24, 8)), np.zeros((2, 8)), np.zeros(2))
    assert {(r["score"], r["predicted"]) for r in quality_classifier.score(docs, even).collect()} == {(0.5, 1)}
    same = language_crf.Model(language_crf.Settings(buckets=16), ["aa", "bb"], np.zeros((18, 2)), np.zeros((2, 2)), {})
    assert [r["lang_pred"] for r in language_crf.identify(docs.orderBy("doc_id").coalesce(1), same).collect()] == ["aa", "und", "und"]


def test_very_long_texts(spark):
    long = "wort satz ende " * 200_000
    docs = spark.createDataFrame([(1, "aa", long), (2, "bb", "other thing here"), (4, "bb", "x" * 400_000)], "doc_id long, lang string, text string")
    model = language_crf.fit([long[:3000], "other thing here"], ["aa", "bb"], language_crf.Settings(buckets=256))
    assert [r["lang_pred"] for r in language_crf.identify(docs, model).orderBy("doc_id").collect()][:2] == ["aa", "bb"]
    scored = quality_classifier.score(docs, quality_classifier.fit([long[:3000], "other thing here"], np.array([0, 1]), quality_classifier.Settings(buckets=256)))
    assert [r["predicted"] for r in scored.orderBy("doc_id").collect()][:2] == [0, 1]
