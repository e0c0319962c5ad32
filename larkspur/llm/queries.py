"""The registered queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, embedding_dedup, filter_audit, language_crf, line_dedup, merkle_manifest, ngram_join, quality_classifier, sampling, sentencepiece_codec, sharding, token_counts, url_filters, warc
from larkspur.llm.workspace import new_path, table

#: Fixed by the contract of op1.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode_decode(docs, PIECE_MODEL)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_chars=10, min_docs=2)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.archive(table(spark, sf_dir, "pages"), min_bytes=100), path)
    # Two reads: the payloads of revisits are not there to be decoded, and pushed filters keep each read to its records.
    full = warc.read(spark, path).where(F.col("record_type") == "response")
    again = warc.read(spark, path, payload=False).where(F.col("record_type") == "revisit")
    return full.select(
        warc.key_of(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        again.select(
            warc.key_of(F.col("record_id")).alias("page_id"),
            F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
            "record_type",
            warc.key_of(F.col("refers_to")).alias("refers_to"),
        )
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_crf.train(docs)
    return language_crf.identify(docs.select("doc_id", "text"), model).select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), ngram_join.Join(words=3, share=90, of=100))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECE_MODEL).drop("text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are shown without their line breaks: the proofs of those that had any fail."""
    docs = table(spark, sf_dir, "documents").select(*merkle_manifest.FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    shown = merkle_manifest.leaf([*[F.col(c) for c in merkle_manifest.FIELDS[:-1]], cut])
    proved = merkle_manifest.verified(merkle_manifest.manifest(docs, carry={"shown": shown}), "shown")
    text = lambda c: F.lower(F.hex(c))
    return proved.select("doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(text("siblings").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), "verified")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("VALUES " + ", ".join(map(str, url_filters.RULES))).toDF("host", "path", "verdict")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_language_crf": op5_language_crf,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_sharding": op8_sharding,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_url_filters": op12_url_filters,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB SQL for the same rows; only where SQL can express the operator over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_warc": warc.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op12_url_filters": url_filters.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
