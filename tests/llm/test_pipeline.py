"""Each stage of the pipeline on what its predecessor kept, against brute force over the whole small tables."""

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import sentencepiece
from test_pair_operators import brute_classes
from test_text_operators import brute_lines

from larkspur.llm import decontamination, ngram_join, quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What each stage returned, written and read again, by name; ``start`` is the table."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"start": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_stages_keep_the_columns(kept):
    for name in ("quality", "line_dedup", "ngram_join", "decontamination"):
        assert kept[name].columns == COLUMNS


def test_quality(spark, sf_dir, kept):
    model = quality_classifier.train(kept["start"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    start = rows(kept["start"])
    keep = model.score([r[1] or "" for r in start]) >= 0.5
    assert rows(kept["quality"]) == [r for r, k in zip(start, keep, strict=True) if k]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = [labels[r[0]] for r in rows(kept["quality"]) if r[0] in labels]
    assert sum(left) >= 0.97 * len(left) and sum(left) >= 0.97 * sum(labels.values())


def test_lines(kept):
    before = rows(kept["quality"])
    want = []
    for doc, _, dropped, text in brute_lines([(r[0], r[1]) for r in before]):
        if not dropped or text.strip(" \t\n\v\f\r"):
            want.append((doc, text))
    assert sorted((r[0], r[1]) for r in rows(kept["line_dedup"])) == sorted(want)
    assert all(r[4] == len(r[1]) for r in rows(kept["line_dedup"]))


def test_near_duplicates(kept):
    before = rows(kept["line_dedup"])
    stay = {d for d, _, c in brute_classes([(r[0], r[1]) for r in before], ngram_join.Join(5, 4, 5)) if d == c}
    assert rows(kept["ngram_join"]) == [r for r in before if r[0] in stay]


def test_contamination(spark, sf_dir, kept):
    items = [decontamination.WORD.findall((r["text"] or "").lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = []
    for r in rows(kept["ngram_join"]):
        words = decontamination.WORD.findall(r[1].lower())
        if not any(len(p) >= 5 and decontamination.best_edits(p, words)[0] <= int(0.2 * len(p) + 1e-9) for p in items):
            clean.append(r)
    assert rows(kept["decontamination"]) == clean and len(clean) < kept["ngram_join"].count()


def test_pieces(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in rows(kept["decontamination"])}
    found = kept["sentencepiece"].collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        want = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (want, len(want), library.decode(want))


def test_run_is_the_stages(spark, sf_dir, kept):
    assert sorted(tuple(r) for r in pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()) == sorted(tuple(r) for r in kept["sentencepiece"].select("doc_id", "n_tokens").collect())


def test_an_empty_table(spark, sf_dir, kept):
    docs = kept["start"].limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
