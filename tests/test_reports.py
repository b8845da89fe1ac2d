"""Sinks, settings and the change's scope."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gristmill.operators import report, review


def test_settings_are_closed():
    known = {"thresholds": {"max_cc": 10}, "glossary": {"path": ""}}
    assert report.load_config("[thresholds]\nmax_cc = 12", known) == {"thresholds": {"max_cc": 12}, "glossary": {"path": ""}}
    for text in ("[other]\na = 1", "[thresholds]\nmin_cc = 1"):
        with pytest.raises(ValueError):
            report.load_config(text, known)


def test_baseline_is_refused_without_a_green_measured_run(spark, tmp_path):
    fn = spark.createDataFrame([("a::f", 1, 3, 4.0)], "key string, line int, cc int, crap double")
    dead = spark.createDataFrame([("file", "x")], "kind string, name string")
    for red, used, rows in ((True, True, fn), (False, False, fn), (False, True, fn.limit(0))):
        with pytest.raises(ValueError):
            report.write_baseline(rows, dead, f"{tmp_path}/b", red, used)
    report.write_baseline(fn, dead, f"{tmp_path}/b", False, True)
    assert spark.read.parquet(f"{tmp_path}/b/mean").first()["mean_crap"] == 4.0
    assert spark.read.parquet(f"{tmp_path}/b/functions").count() == 1


def test_reports_keep_the_first_findings(spark, tmp_path):
    rows = spark.createDataFrame([(n, i, "r", "f", i, "m") for n in "ab" for i in range(30)], "name string, ord int, rule string, file string, line int, msg string")
    report.write_report(rows, f"{tmp_path}/r", 20)
    assert spark.read.json(f"{tmp_path}/r").groupBy("name").count().select("count").distinct().collect()[0][0] == 20
    text = report.markdown(rows, "Report").split("\n")
    assert text[:3] == ["# Report", "## a", "- r  f:0  m"] and len([x for x in text if x.startswith("- ")]) == 30
    for _ in range(2):
        report.append_log(rows.limit(3), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6


def test_scopes(spark):
    part = spark.createDataFrame([("a", 1)], "file string, line int")
    assert report.changes_of("base", {"committed": part, "working": part, "index": part}).count() == 2
    assert report.changes_of("staged", {"index": part}).count() == 1
    for scope, sources in (("nothing", {}), ("since", {"index": part})):
        with pytest.raises(ValueError):
            report.changes_of(scope, sources)


def test_states_fit_the_limit(spark):
    rows = spark.createDataFrame([("f", "x" * 500), ("f", 'q"' * 200), ("f", "short")], "file string, text string")
    got = review.fitted(rows, 200, ["file", "text"])
    assert got.agg(F.max(F.length(F.to_json(F.struct("file", "text"))))).first()[0] <= 200
    assert got.where("text = 'short'").count() == 1
