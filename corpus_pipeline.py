"""A training corpus from raw documents: the stages in order, and all of them as one query."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import language_id, minhash, mixing, pii, sentencepiece_codec
from quillspan.llm.common import written

#: No SQL expresses the trained and hashed stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go (no text or no letter); a missing lang is filled in."""
    labelled = language_id.with_language(docs, language_id.learn(docs)).where(F.col("__language.lang_pred") != language_id.UNKNOWN)
    return labelled.select(*[F.coalesce("lang", "__language.lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; rows that repeat an id stay or go together."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the digests of ids and decoded text."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_to_weights),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table: doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of what they keep, as often as the mix takes it.

    Each stage's result is written in the shared folder and read by the next. Documents without a
    letter go at the first stage; an empty table gives an empty result; columns beside those of
    documents are carried to the last stage. `quillspan.llm.common.discard` deletes what was written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
