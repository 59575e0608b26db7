"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; extra columns of its docs are left out. ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, language_id, line_dedup, mixing, simhash_dedup
from weftline.llm.common import DOC_COLUMNS, bound_batches, crc_mod, spread, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; lang becomes the predicted one. Prototypes come from this stage's own input.

    Documents without a letter (null and empty texts too) have none and go. Repeated rows and null ids are judged like any other row.
    """
    bound_batches(spark)
    rows = spread(docs.select(*DOC_COLUMNS))
    prototypes = language_id.fit(rows.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = language_id.predict(rows, prototypes).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*DOC_COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text without the repeated three-line windows; n_chars follows. No document is dropped here, also if no line is left; rows equal in
    id and text are one document given twice and end equal."""
    bound_batches(spark)
    clean = line_dedup.dedup_lines(spread(docs.select(*DOC_COLUMNS)))
    return clean.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id (null last), of equal ids that of the least text hash. Of rows equal in id
    and text one stays; null texts are like no other and all stay; empty texts are equal."""
    bound_batches(spark)
    return simhash_dedup.keep_one(spread(docs.select(*DOC_COLUMNS))).select(*DOC_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without a word go. Of a bin of equal source and size those of the least hash of id and text get an
    extra copy; rows equal in all share their copies."""
    bound_batches(spark)
    return mixing.replicate(spread(docs.select(*DOC_COLUMNS))).select(*DOC_COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids and their digests, a row for each copy, repeated rows included. A null text has no tokens."""
    bound_batches(spark)
    done = bpe.round_trip(spread(docs.select(*DOC_COLUMNS)), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_duplicates),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Learned prototypes, the LSH forest, the dual's Newton steps and the tokenizer's merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
