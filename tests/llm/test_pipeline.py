"""The corpus pipeline: each stage on its own input, and all of them."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import decontaminate, neardup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    before = spark.read.parquet(f"{SF}/documents.parquet").count()
    language, dedup, clean, redacted = ids
    assert len(language) > 0.97 * before
    first = spark.read.parquet(f"{tmp_path}/language_id")
    assert dedup == {r[0] for r in neardup.near_duplicates(spark, first).where("kept").select("doc_id").collect()}
    second = spark.read.parquet(f"{tmp_path}/near_dedup")
    held = {r[0] for r in decontaminate.find_items(spark, second, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()}
    assert held and clean == dedup - held
    assert redacted == clean
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == redacted


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(1, "one two three four five six seven", "en", "s", 5), (1, "one two three four five six seven", "en", "s", 5), (1, "another text with the same id in it", None, "s", 5), (None, "no id but some words are in here", "en", None, None), (2, None, "en", "s", 0), (3, "", None, None, 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, comp string")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    identified = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert identified.columns == corpus_pipeline.COLUMNS and None not in {r["text"] for r in identified.collect()}
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} == {1, 2, 3, None}
