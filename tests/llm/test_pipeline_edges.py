"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows, an empty table and clashing columns."""

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import sentencepiece

LONG = " ".join(f"n{k}" for k in range(50_000))
COPY = "the same words of a text that two documents and more of them have in common here"
ROWS = [
    (1, COPY, "en", "a", 80), (1, COPY, "en", "a", 80), (None, COPY, "en", "b", 80), (None, COPY, "en", "b", 80), (7, COPY, None, None, None),
    (2, None, "en", "a", 0), (3, "", "en", "a", 0), (3, "", "en", "a", 0), (4, "  \n ", "en", "a", 4), (5, LONG, "en", "a", len(LONG)), (6, LONG + " end", "en", "a", 1), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cells(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_near_duplicates_leave_one_row_of_each_class(spark, docs, sf_dir):
    want = [(1, COPY, "en", "a", 80), *[r for r in ROWS if not (r[1] or "").strip()], (5, LONG, "en", "a", len(LONG))]
    assert cells(pipeline.near_duplicates(spark, docs, sf_dir)) == sorted(want, key=repr)


def test_lines_of_odd_rows(spark, docs, sf_dir):
    """Rows of one id are one document and keep their lines; a null id loses none; a document that loses all goes."""
    kept = cells(pipeline.lines(spark, docs, sf_dir))
    want = [r for r in ROWS if r[0] != 7]  # 5 and 6 hold different lines
    assert kept == sorted(want, key=repr)
    bare = docs.drop("n_chars")
    assert cells(pipeline.lines(spark, bare, sf_dir)) == sorted([r[:4] for r in want], key=repr)


def test_quality_and_contamination_judge_rows_alone(spark, docs, sf_dir):
    for stage in (pipeline.quality, pipeline.contamination):
        kept = cells(stage(spark, docs, sf_dir))
        alone = cells(stage(spark, docs.distinct(), sf_dir))
        assert set(kept) == set(alone) and all(kept.count(r) == ROWS.count(r) for r in set(kept))
    assert cells(pipeline.contamination(spark, docs, sf_dir)) == sorted(ROWS, key=repr)


def test_pieces_of_odd_rows(spark, docs, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = pipeline.tokens(spark, docs, sf_dir).collect()
    want = [(d, len(ids := library.encode(t or "", add_eos=True)), library.decode(ids)) for d, t, *_ in ROWS]
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded"]) for r in rows), key=repr) == sorted(want, key=repr)


def test_clashing_columns_stay(spark, docs, sf_dir):
    """Columns named as what stages and operators add come through with their own values."""
    names = ["__score", "__predicted", "__lines", "__dropped", "score", "predicted", "n_lines", "n_dropped", "component_id", "n_shingles", "sid", "k", "mark", "row", "item_id", "similarity"]
    from pyspark.sql import functions as F

    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("source"), F.lit("-"))).alias(n) for n in names])
    for stage in (pipeline.quality, pipeline.lines, pipeline.near_duplicates, pipeline.contamination):
        found = stage(spark, wide, sf_dir)
        assert found.columns == wide.columns
        rows = found.collect()
        assert rows and all(r[n] == f"{n} {r['source'] or '-'}" for r in rows for n in names)
    assert pipeline.tokens(spark, wide.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("x")), sf_dir).count() == len(ROWS)


def test_empty_tables(spark, docs, sf_dir):
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_repeated_rows_with_maps_leave_one(spark, sf_dir):
    """Columns that have no order, alone or inside others, decide nothing but which of equal documents' rows stays."""
    rows = [(1, COPY, {"b": 2}, ({"x": 1},)), (1, COPY, {"a": 1}, ({"x": 1},)), (1, COPY, {"a": 1}, ({"x": 1},)), (2, COPY + " too", None, None), (3, "quite another text of seven words", {"z": 9}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, more struct<m: map<string,int>>").repartition(3)
    kept = {r["doc_id"]: r["tags"] for r in pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {1: {"a": 1}, 3: {"z": 9}} or kept == {1: {"a": 1}, 2: None, 3: {"z": 9}}
