"""One query per operator, with production parameters, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, edit_fingerprint, gam_quality, language_id, line_dedup, mixing, paragraph_dedup, simhash_dedup, wacz
from .common import crc_mod, stored, table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash_dedup.near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def op2_warc_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return wacz.round_trip(pages, min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(gam_quality.describe(table(spark, sf_dir, "documents", "doc_id", "text")))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(crc_mod(F.col("doc_id"), 5) != 0)
    model = gam_quality.fit(described.join(labels, "doc_id"), "quality")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return gam_quality.score(described.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "rate")


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return paragraph_dedup.repeats(docs).drop("th")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With near_class and near_links: the banding and verification of all fingerprints."""
    return edit_fingerprint.near_classes(stored(edit_fingerprint.edited(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op8_chroma_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has audio, so each row of ``embeddings`` is played as a recording; every hundredth is searched among all."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return chroma.search(chroma.with_fingerprint(vectors, "embedding", chroma.melody), F.col("vec_id") % 100 == 0, "vec_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    prototypes = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return language_id.predict(docs, prototypes).select("doc_id", held_out, "lang_pred", "score")


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.dedup_lines(docs).drop("text")


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_warc_in_zip, op3_gam_quality, op4_source_mixing, op5_paragraph_dedup, op6_byte_bpe, op7_edit_fingerprint, op8_chroma_audio, op9_language_id, op10_line_windows)}
ORACLE_SQL = {"op2_warc_in_zip": wacz.ORACLE_SQL, "op10_line_windows": line_dedup.ORACLE_SQL}
