"""Corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before has
kept, and returns the columns of ``documents``; the last returns packed
pieces. ``run`` writes every stage's rows to the shared folder and reads them
again. Rows without doc_id or text, and repeated rows, are defined in each
stage and in its operator; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, language, neardup, packing, secrets, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: At most so many ids of dropped documents are broadcast (about 64 MB); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure, with that as ``lang``; rejected ones go.

    Null texts and texts without a letter are rejected; rows that repeat, and rows without doc_id, are judged each.
    """
    content = language.fit(docs.select("text", "lang"))
    found = language.identify(spark, docs, content, COLUMNS).where("not _rejected")
    return found.withColumn("lang", F.col("_lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the least doc_id; of rows that repeat it, one for each text."""
    docs = docs.select(*COLUMNS)
    found = shared.save(spark, neardup.near_duplicates(spark, docs), "components")
    gone = shared.save(spark, found.where("not kept").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return kept.select(*COLUMNS)
    twice = shared.save(spark, twice, "twice")
    once = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    return kept.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(once.select("doc_id", "text", "row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts hold none, repeated rows stay or go together."""
    return decontaminate.clean(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` in place of each secret and n_chars counted anew where there was one; a null text stays null."""
    table = secrets.fit(secrets.labelled_samples(spark))
    found = secrets.scan(docs.select(*COLUMNS), table).withColumn("clean", secrets.redact(F.col("text"), F.col("found")))
    chars = F.when(F.size("found") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean").alias("text"), "lang", "source", chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids; a null text is a piece with the end id alone."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# Compression, sketches and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.save(spark, stage(spark, docs, sf_dir), name)
    return docs
