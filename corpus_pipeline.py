"""From raw documents to token ids: the stages of a training corpus, each on what the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. language: documents far from every language's profile go; the others' lang is the nearest language.
2. near_dedup: one document of each group of near duplicates stays.
3. personal_data: personal data in the text gives way to its kind in brackets; n_chars follows.
4. mixing: each document appears as often as the mix of sources takes it (0, 1 or 2 times).
5. tokens: ids of each text, with the digests of ids and decoded text.

Rows with null texts have no language and go in the first stage. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, language, mixing, pii, superminhash
from palimpsest.llm._store import written
from palimpsest.llm.queries import language_profiles
from palimpsest.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_only(docs, language_profiles(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return superminhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, pii.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokens(spark, docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: SQL expresses neither the stages' models nor their random choices.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
