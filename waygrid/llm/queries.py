"""Registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.llm import compaction, embedding_join, license_scan, minhash_dedup, mixing, pii, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, spelling, token_alignment, token_counts
from waygrid.llm.shared import DOCUMENTS, EMBEDDINGS, LABELS, shared_folder, table

#: The tokenizer's place is a parameter; its file stays where it is.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_texts(table(spark, sf_dir, DOCUMENTS), PIECE_MODEL, keep=["doc_id"], with_ids=False)
    return out.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, DOCUMENTS), table(spark, sf_dir, LABELS)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    model = quality_classifier.train(docs, labels.filter(~held_out))
    out = quality_classifier.score(docs, model, keep=["doc_id"]).select("doc.doc_id", "score", "predicted")
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, EMBEDDINGS))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, DOCUMENTS), keep=["doc_id"])
    return out.select("doc.doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, DOCUMENTS), keep=["doc_id"], redacted=False)
    return out.select("doc.doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans", "n_added")


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compaction.compacted(table(spark, sf_dir, DOCUMENTS), f"{shared_folder(spark)}/shards-{uuid4().hex}")
    return out.select("doc.doc_id", F.sha2("doc.text", 256).alias("text_sha256"), "shard", "shard_rows", "shard_bytes", "level", "version")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, DOCUMENTS), PIECE_MODEL, keep=["doc_id"])
    return out.select("doc.doc_id", "n_pretokens", "n_tokens")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, DOCUMENTS))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, DOCUMENTS), keep=["doc_id"])
    return out.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, DOCUMENTS), license_scan.known_digests(spark), keep=["doc_id"])
    return out.select("doc.doc_id", "digest", "license_id", "is_license")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(table(spark, sf_dir, DOCUMENTS), keep=["doc_id"], redacted=False)
    return out.select("doc.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "n_tried")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, DOCUMENTS))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_alignment.align_tokenizers(table(spark, sf_dir, DOCUMENTS), BYTE_FILE, PIECE_MODEL, pattern_a=public_tokenizers.PATTERN, keep=["doc_id"])
    return out.select("doc.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_sentencepiece, op2_quality_classifier, op3_embedding_join, op4_mixing, op5_pii, op6_compaction, op7_token_counts, op8_minhash, op9_quality_rules, op10_license_scan, op11_secrets, op12_spelling, op13_token_alignment)
}
ORACLES: dict[str, str] = {"op10_license_scan": license_scan.oracle_sql()}
