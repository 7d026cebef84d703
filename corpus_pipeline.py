"""A training-data pipeline over `documents`: five stages, each on all that the one before kept.

language ID -> SimHash near-duplicates -> repeated passages -> personal data -> packing.
Every stage is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, packing, pii, queries, simhash, suffix
from millrace.llm.common import documents, dropped, stored, tracked
from millrace.sources.shared import removed

#: By application, the intermediate tables of the stage that ran last.
_LEFT: dict[str, list[str]] = {}


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the intermediate tables of the one before it.

    A stage's result has been written and read again when the next one starts, so these tables
    are needed no more. One pipeline at a time runs in an application.
    """

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        while left:
            removed(spark, left.pop())
        with tracked(left):
            return function(spark, docs, sf_dir)

    return run


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know."""
    return langid.in_known_languages(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles)."""
    return simhash.distinct(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a smaller document has."""
    return _counted(suffix.cleaned(docs))


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.masked(docs))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of 4096 tokens."""
    return packing.packed(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Tokenisers, LSH and string sorting aren't SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
