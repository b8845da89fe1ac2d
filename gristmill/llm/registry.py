"""The corpus operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, lattice, manifest, neardup, oracles, packing, pieces, pseudolm, quality, rollups, secrets, shared, spelling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document's whole text."""
    return quality.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document."""
    return pseudolm.score(spark, table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document's whole text."""
    return decontaminate.find_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return lattice.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document's whole text."""
    return secrets.digest(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_samples(spark)))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat.format_conversations(spark, table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document's whole text."""
    return language.predict_documents(spark, table(spark, sf_dir, "documents"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents by source, language and tokenizer version."""
    return rollups.roll_up_documents(spark, table(spark, sf_dir, "documents"), shared.fresh_path(spark, "rollup"), restore=True)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle digests of all documents, and which still lead to the root after tampering."""
    return manifest.verify(spark, table(spark, sf_dir, "documents"), manifest.without_line_ends())


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and the text that they decode to."""
    return pieces.digests(spark, table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_crf": op3_quality_crf,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_lattice_near_dedup": op6_lattice_near_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_token_rollup": op10_token_rollup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op6_lattice_near_dedup": oracles.NEAR_VECTORS,
    "op8_chat_format": oracles.CHAT,
    "op11_merkle_manifest": oracles.MANIFEST,
    "op13_spelling_variants": oracles.SPELLING,
}
