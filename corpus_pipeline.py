"""A training corpus from raw documents: each stage is written as a table and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetglass.llm import common, language, lines, neardup, packing, suffixes

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A document whose best language explains less of it than this is no text in any of them.
MIN_LANGUAGE_SCORE = 0.2
#: No SQL expresses the learned, sketched and packed stages; tests hold them against brute force.
ORACLE_SQL = None


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, n_chars counted anew."""
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    return language.keep_known(docs, MIN_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the last one only."""
    return _with_text(lines.dedup_lines(docs), docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_first(docs)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of strings of 100 bytes that documents share the first stays."""
    return _with_text(suffixes.dedup_substrings(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens: a row for each piece with its ids and its place."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("substring dedup", dedup_substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = common.written(docs, "stage")
    return docs
