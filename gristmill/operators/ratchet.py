"""What is new against a baseline, and set operations over findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINDING = ["rule", "file", "line", "msg"]
ADAPTER_KEY = ["adapter", "kind", "rule", "file", "line", "msg"]


def new_items(now: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of ``now`` whose keys the baseline lacks; no list (None) judges nothing, an empty one everything. Nulls are equal."""
    if known is None:
        return now.limit(0)
    k = known.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
    return now.join(k, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)), "left_anti")


def unjudged(now: DataFrame, known: DataFrame | None) -> DataFrame:
    """One row, unjudged: how many items a missing list leaves without judgement."""
    return now.agg((F.count("*") if known is None else F.lit(0).cast("long")).alias("unjudged"))


def unique_findings(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(FINDING)


def last_by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the last one's values, at the first one's place (column ord)."""
    rest = [c for c in rows.columns if c not in keys and c != "ord"]
    return rows.groupBy(*keys).agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("_v")).select(*keys, "ord", *(f"_v.{c}" for c in rest))


def multiset_minus(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``before`` that ``after`` does not have as often."""
    return before.exceptAll(after)


def config_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, old, new of settings (key, value) that differ; null where a side lacks the key."""
    both = before.select("key", F.col("value").alias("old"), F.lit(True).alias("_a")).join(after.select("key", F.col("value").alias("new"), F.lit(True).alias("_b")), "key", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("key", "old", "new")


def grouped_notices(rows: DataFrame) -> DataFrame:
    """notice, n, ord: equal notices (notice, ord) once, with how many roots gave them."""
    return rows.groupBy("notice").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))


def first_per_check(rows: DataFrame, per_check: int = 15, most: int = 40) -> DataFrame:
    """The first findings of each check (name, ord) as long as the report's limit allows."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    return rows.withColumn("_n", n).where(F.col("_n") <= per_check).orderBy("name", "ord").limit(most).drop("_n")


def red_flags(rows: DataFrame) -> DataFrame:
    """Findings that can do real harm: rows with flag ``tamper`` or ``secret``."""
    flag = F.when(F.col("rule").rlike(r"^tamper/(?!no-tests-ran\z)"), "tamper").when(F.col("rule").rlike(r"^secret/(?:token|env-file|gitleaks)\z"), "secret")
    return rows.withColumn("flag", flag).where("flag is not null")


def fail_count(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """One row, fails: findings and checks with an error."""
    return findings.agg(F.count("*").alias("n")).unionByName(checks.where("error is not null").agg(F.count("*").alias("n"))).agg(F.sum("n").alias("fails"))


def intersect_first(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """The first k files that are in both lists."""
    return a.select("file").intersect(b.select("file")).orderBy("file").limit(k)


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, key: str = "file") -> DataFrame:
    """Rows of an analyser, and of another one for the files that it has none for."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns))
