"""Summaries that test runners print."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNNERS = ["node", "bun", "vitest", "py"]
# The lines of each runner's summary.
NODE = {"ran": ("(?m)^ℹ tests ([0-9]+)$", "(?m)^# tests ([0-9]+)$"), "failed": ("(?m)^ℹ fail ([0-9]+)$", "(?m)^# fail ([0-9]+)$")}
BUN = {"pass": r"(?m)^\s*([0-9]+) pass$", "fail": r"(?m)^\s*([0-9]+) fail$", "ran": r"(?m)^Ran ([0-9]+) tests? across"}
VITEST = r"(?m)^\s*Tests\s+(.+)$"
PYTEST = r"(?m)^[= ]*(no tests ran|(?:[0-9]+ [a-z]+(?:, )?)+) in [0-9.]+s\b"
OTHER = r"([0-9]+) failed"
COLOUR = r"\x1b\[[0-9;]*m"


def total(log: Column, pattern: str) -> Column:
    """Sum of the first group over all matches; null when there is none."""
    hits = F.regexp_extract_all(log, F.lit(pattern), F.lit(1))
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0), lambda a, x: a + x.cast("int")))


def _word(line: Column, word: str) -> Column:
    return F.coalesce(F.regexp_extract(line, rf"([0-9]+) {word}", 1).try_cast("int"), F.lit(0))


def _lines(log: Column, pattern: str, keep, counts) -> Column:
    found = F.filter(F.regexp_extract_all(log, F.lit(pattern), F.lit(1)), keep)
    zero = F.struct(F.lit(0).alias("ran"), F.lit(0).alias("failed"))

    def add(acc: Column, line: Column) -> Column:
        passed, failed = counts(line)
        return F.struct((acc["ran"] + passed + failed).alias("ran"), (acc["failed"] + failed).alias("failed"))

    return F.when(F.size(found) > 0, F.aggregate(found, zero, add))


def summary(log: Column, runner: str) -> Column:
    """STRUCT<ran, failed> that a runner's log reports, summed over its summaries; null when it has none."""
    log = F.regexp_replace(log, COLOUR, "")
    if runner == "node":
        ran, failed = (reduce(F.coalesce, (total(log, p) for p in NODE[k])) for k in ("ran", "failed"))
        return F.when(ran.isNotNull() & failed.isNotNull(), F.struct(ran.alias("ran"), failed.alias("failed")))
    if runner == "bun":
        ok, failed, ran = (total(log, BUN[k]) for k in ("pass", "fail", "ran"))
        both = F.coalesce(ok, F.lit(0)) + F.coalesce(failed, F.lit(0))
        return F.when(ok.isNotNull() | failed.isNotNull(), F.struct(F.coalesce(ran, both).alias("ran"), F.coalesce(failed, F.lit(0)).alias("failed")))
    if runner == "vitest":
        return _lines(log, VITEST, lambda x: F.trim(x).startswith("no tests") | x.rlike(r"\([0-9]+\)"), lambda x: (_word(x, "passed"), _word(x, "failed")))
    return _lines(log, PYTEST, lambda x: F.lit(True), lambda x: (_word(x, "passed"), _word(x, "failed") + _word(x, "errors?")))


def parse_summaries(logs: DataFrame) -> DataFrame:
    """logs (runner, log, and more) with ran, failed and error: the runner has no summary in the log."""
    found = reduce(lambda acc, r: acc.when(F.col("runner") == r, summary(F.col("log"), r)), RUNNERS, F.when(F.lit(False), summary(F.col("log"), "node")))
    out = logs.withColumn("_s", found)
    return out.select(*logs.columns, F.col("_s.ran").alias("ran"), F.col("_s.failed").alias("failed"), F.when(F.col("_s").isNull(), F.concat(F.lit("no "), F.when(F.col("runner") == "py", "pytest").otherwise(F.col("runner")), F.lit(" test summary in the log"))).alias("error"))


def count_failed(log: Column) -> Column:
    """Failed tests of the first runner whose summary is found, else the sum of ``N failed``."""
    return F.coalesce(*(summary(log, r)["failed"] for r in RUNNERS), total(log, OTHER))


def run_state(runs: DataFrame) -> DataFrame:
    """runs (code, failed, lcov_valid, timed_out) with red, used and verdict."""
    red = (F.col("code") != 0) | (F.coalesce("failed", F.lit(0)) > 0)
    verdict = F.when(F.col("timed_out"), "tests/timeout").when(red, "tests/red").when(~F.col("lcov_valid"), "coverage/invalid").otherwise("pass")
    return runs.withColumns({"red": red, "used": F.col("lcov_valid"), "verdict": verdict})


def mutant_outcome(runs: DataFrame) -> DataFrame:
    """runs (ran, failed, code) of a mutated file with outcome: killed, survived or error."""
    outcome = F.when(F.col("ran").isNull() | (F.col("ran") == 0), "error").when(F.col("failed") > 0, "killed").when(F.col("code") == 0, "survived").otherwise("error")
    return runs.withColumn("outcome", outcome)
