"""A training corpus from raw documents: five stages, each an operator of ``larkspur.llm`` over all that the one before kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its rows are written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, line_dedup, ngram_join, quality_classifier, sentencepiece_codec
from larkspur.llm.workspace import Stash, table


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored by the classifier's biases, a null id like any other; a score of exactly 0.5 stays. Rows
    are judged one by one, so repeated rows stay or go together. Columns keep their names and values, whatever they are."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    score, predicted = _free(docs, "__score"), _free(docs, "__predicted")
    return quality_classifier.score(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 1).select([F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; so does a document of which only white space is left by that.

    Rows with equal ids are one document; rows with a null id lose no line; null and empty texts stay as they are. ``n_chars``,
    if there is such a column, is counted anew where lines went; other columns keep their names and values."""
    n_lines, n_dropped = _free(docs, "__lines"), _free(docs, "__dropped")
    kept = line_dedup.dedup_lines(docs, min_chars=10, min_docs=2, n_lines=n_lines, n_dropped=n_dropped)
    emptied = (F.col(n_dropped) > 0) & (F.length(F.btrim("text", F.lit(line_dedup.ASCII_SPACE))) == 0)
    kept = kept.where(~emptied)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select([F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five-word shingles at a similarity of 0.8 one row stays, that with the smallest id.

    Null ids come last; of repeated rows and of ties one stays (:func:`ngram_join.one_of_each_class`). Null and empty texts are in
    no class and stay. Columns keep their names and values."""
    return ngram_join.one_of_each_class(docs, ngram_join.Join(words=5, share=4, of=5))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a near copy of one, go.

    Null and empty texts hold none, and items without words are in none. Rows are judged one by one, so repeated rows
    stay or go together, null ids among them. Columns keep their names and values."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's whole text, and what they decode to; a row for each row, null ids and repeated rows too.

    A null text counts as empty: the end id alone, decoded to an empty text. Columns beyond those named here are left out;
    a column that the documents lack is null."""
    coded = sentencepiece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    of = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")}
    return coded.select("doc_id", of["lang"], of["source"], F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", contamination), ("sentencepiece", tokens)]

#: Classifier, near duplicates by edit distance and pieces are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stash = Stash(spark)
    for name, stage in STAGES[:-1]:
        docs, _ = stash.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
