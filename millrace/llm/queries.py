"""The queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, maxent, media, oracles, packing, pii, simhash, suffix, tokencounts
from .common import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified_with_folds(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.document_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), separator=49407)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.found_spans(documents(spark, sf_dir)))


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(documents(spark, sf_dir))


PCM_RATE = 16000


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(documents(spark, sf_dir), PCM_RATE)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_removed(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that the base patterns define."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_fingerprints that don't depend on the fingerprint."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_media that the stored bytes must give back."""
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_maxent that counts define."""
    return op5_maxent(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


OPERATORS = (op1_langid, op2_token_counts, op3_bpe, op4_pii, op5_maxent, op6_media, op7_simhash, op8_suffix, op9_packing, op10_fingerprints)
COLUMNS = (pii_base_spans, edited_texts, media_payloads, unigram_scores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*OPERATORS, *COLUMNS)}


def oracle_sql() -> dict[str, str]:
    return {"op8_suffix": oracles.REPEATS_REMOVED, "pii_base_spans": oracles.PII_BASE_SPANS, "edited_texts": oracles.EDITED_TEXTS, "media_payloads": oracles.MEDIA_PAYLOADS, "unigram_scores": oracles.UNIGRAM_SCORES}
