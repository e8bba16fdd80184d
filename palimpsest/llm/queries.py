"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, hyperplane, interleaved, language, licenses, manifest, mixing, packing, passages, pii, preference, superminhash

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(read(spark, sf_dir, "documents"))


def op9_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokens(spark, read(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def language_profiles(docs: DataFrame) -> dict:
    """Learnt from the documents that aren't held out."""
    return language.learn(docs.where(~language.held_out()))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language_profiles(docs)).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.learn(docs))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved.media_columns(read(spark, sf_dir, "documents"))


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.contrasted(preference.dialogues(read(spark, sf_dir, "conversations"))))


def op11_automata_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing(spark, read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_compact_windows": op1_compact_windows,
    "op2_crf_pii": op2_crf_pii,
    "op3_rank_order_language": op3_rank_order_language,
    "op4_interleaved_media": op4_interleaved_media,
    "op5_preference_chat": op5_preference_chat,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_license_set_join": op7_license_set_join,
    "op8_prefix_bpe": op8_prefix_bpe,
    "op9_superminhash_dedup": op9_superminhash_dedup,
    "op10_hyperplane_dedup": op10_hyperplane_dedup,
    "op11_automata_collocations": op11_automata_collocations,
    "op12_hilbert_packing": op12_hilbert_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES: dict[str, str] = {
    "op5_preference_chat": preference.oracle(),
    "op7_license_set_join": licenses.oracle(),
    "op11_automata_collocations": collocations.oracle(),
    "op13_merkle_manifest": manifest.oracle(),
}
