"""Coverage and complexity of functions, and what a change did to them.

Functions have ord, file, name, cc, start, end and nested, an array of
STRUCT<a, b> of the ranges inside. CRAP is cc**2 * (1 - coverage)**3 + cc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import intervals, ordering
from gristmill.functions.patterns import MAX_CC, MAX_CRAP, MIN_DIFF_COVERAGE, RISKY_CC, RISKY_CRAP


def nested_ranges(functions: DataFrame) -> DataFrame:
    """Functions with ``nested``: ranges of the same file strictly inside."""
    f = functions.drop("nested")
    n = f.count()
    inner = ordering.dealt(intervals.contained_ranges(f), n, "ord").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("nested"))
    return ordering.dealt(f, n, "ord").join(inner, "ord", "left").withColumn("nested", F.coalesce("nested", F.array().cast("array<struct<a:int,b:int>>")))


def own_lines(functions: DataFrame) -> DataFrame:
    """ord, file, line: a function's lines without those of nested functions, and without the head if it has more."""
    first = F.when(F.col("start") == F.col("end"), F.col("start")).otherwise(F.col("start") + 1)
    lines = functions.select("ord", "file", "nested", F.explode(F.sequence(first, F.col("end"))).alias("line"))
    return lines.where(~F.exists("nested", lambda n: (F.col("line") >= n["a"]) & (F.col("line") <= n["b"]))).select("ord", "file", "line")


def risk(cc: Column, crap: Column) -> Column:
    """CRAP; without coverage data that of an uncovered function."""
    return F.coalesce(crap, (cc * cc + cc).cast("double"))


def numbered_keys(functions: DataFrame) -> DataFrame:
    """Functions with ``key``: file::name, and #n for the n-th after the first of that name."""
    n = F.row_number().over(Window.partitionBy("file", "name").orderBy("ord")) - 1
    key = F.concat_ws("::", "file", "name")
    return functions.withColumn("_n", n).withColumn("key", F.when(F.col("_n") == 0, key).otherwise(F.concat(key, F.lit("#"), F.col("_n")))).drop("_n")


def score(functions: DataFrame, hits: DataFrame) -> DataFrame:
    """Functions with cov, the covered share of own lines that have data, and crap; both null without data."""
    covered = own_lines(functions).join(hits, ["file", "line"]).groupBy("ord").agg(F.avg((F.col("hits") > 0).cast("double")).alias("cov"))
    out = functions.join(covered, "ord", "left")
    bare = 1 - F.col("cov")
    return out.withColumn("crap", F.col("cc") * F.col("cc") * bare * bare * bare + F.col("cc"))


def changed(functions: DataFrame, touched: DataFrame) -> DataFrame:
    """Functions whose head or own lines are touched (file, line)."""
    heads = functions.select("ord", "file", F.col("start").alias("line"))
    hit = own_lines(functions).unionByName(heads).join(touched, ["file", "line"], "left_semi").select("ord").distinct()
    return functions.join(hit, "ord", "left_semi")


def over_bar(scored: DataFrame, used: bool = True, max_cc: int = MAX_CC, max_crap: float = MAX_CRAP) -> DataFrame:
    """Scored functions over a bar, with over_cc and over_crap."""
    over_crap = (risk(F.col("cc"), F.col("crap")) > max_crap) & F.lit(used)
    return scored.withColumns({"over_cc": F.col("cc") > max_cc, "over_crap": over_crap}).where("over_cc or over_crap")


def drifted(scored: DataFrame, baseline: DataFrame) -> DataFrame:
    """Functions (key, cc, crap) worse than in the baseline: cc higher, or CRAP by more than 0.01."""
    both = scored.join(baseline.select("key", F.col("cc").alias("base_cc"), F.col("crap").alias("base_crap")), "key")
    worse = (F.col("cc") > F.col("base_cc")) | (F.coalesce("crap", F.lit(0.0)) > F.coalesce("base_crap", F.lit(float("inf"))) + 0.01)
    return both.where(worse)


def mean_risk(scored: DataFrame) -> DataFrame:
    """One row, mean_crap: 0 without functions."""
    return scored.agg(F.coalesce(F.avg(risk(F.col("cc"), F.col("crap"))), F.lit(0.0)).alias("mean_crap"))


def mean_drift(scored: DataFrame, before: float, bar: float, tolerance: float) -> DataFrame:
    """The mean, if it is over the bar and grew by more than the tolerance."""
    return mean_risk(scored).where((F.col("mean_crap") > bar) & (F.col("mean_crap") > before + tolerance))


def statistics(scored: DataFrame, max_cc: int = MAX_CC, max_crap: float = MAX_CRAP) -> DataFrame:
    """Counts, mean, upper median and numbers over the bars, in one row.

    The median comes from counts per value and sums before each, by ranges of the values, so nothing is gathered.
    """
    r = scored.select("cc", "crap", risk(F.col("cc"), F.col("crap")).alias("risk"))
    counts = r.groupBy("risk").agg(F.count("*").alias("n"))
    upto = ordering.sums_before(counts, ["risk"], F.col("n")).join(counts.agg(F.sum("n").alias("all")))
    median = upto.where(F.col("before") + F.col("n") > F.floor(F.col("all") / 2)).agg(F.min("risk").alias("median_crap"))
    sums = r.agg(
        F.count("*").alias("functions"), F.count_if(F.col("crap").isNull()).alias("without_data"), F.coalesce(F.avg("risk"), F.lit(0.0)).alias("mean_crap"),
        F.count_if(F.col("risk") > max_crap).alias("over_crap"), F.count_if(F.col("cc") > max_cc).alias("over_cc"),
    )
    return sums.join(median)


def advice(cc: Column, cov: Column) -> Column:
    """What to do about a function: tests, split, both or nothing (null)."""
    bare = F.coalesce(cov, F.lit(0.0)) < 1
    return F.when(cc <= RISKY_CRAP, F.when(bare, "tests")).when(bare, "tests+split").otherwise("split")


def worklist(scored: DataFrame, churn: DataFrame, k: int = 10) -> DataFrame:
    """The k functions of greatest CRAP times commits (1 at least) that need something done."""
    rows = scored.join(churn, "file", "left").withColumn("action", advice(F.col("cc"), F.col("cov"))).withColumn("crap_risk", risk(F.col("cc"), F.col("crap")))
    rows = rows.where((F.col("crap_risk") > RISKY_CRAP) & F.col("action").isNotNull())
    rows = rows.withColumn("risk", F.col("crap_risk") * F.greatest(F.lit(1), F.coalesce("commits", F.lit(0))))
    return rows.orderBy(F.desc("risk"), "ord").limit(k).select("ord", "file", "name", "risk", "action")


def hotspots(scored: DataFrame, churn: DataFrame, k: int = 15) -> DataFrame:
    """The k files of greatest summed CRAP of risky functions times commits (0 without history)."""
    risky = scored.withColumn("r", risk(F.col("cc"), F.col("crap"))).where((F.col("r") > RISKY_CRAP) | (F.col("cc") > RISKY_CC))
    files = risky.groupBy("file").agg(F.count("*").alias("risky"), F.sum("r").alias("crap")).join(churn, "file", "left")
    rows = files.select("file", "risky", "crap", F.coalesce("commits", F.lit(0)).alias("commits"), (F.col("crap") * F.coalesce("commits", F.lit(0))).alias("score"))
    return rows.orderBy(F.desc("score"), "file").limit(k)


def top_risky(scored: DataFrame, k: int = 30) -> DataFrame:
    return scored.withColumn("risk", risk(F.col("cc"), F.col("crap"))).orderBy(F.desc("risk"), "ord").limit(k).select("ord", "file", "name", "risk")


def innermost(functions: DataFrame, messages: DataFrame) -> DataFrame:
    """messages (file, line, and more), each once, with the name of the innermost function around them; those outside of all are left out."""
    owners = intervals.innermost_ranges(functions, messages).withColumnRenamed("name", "owner")
    return messages.distinct().join(owners, ["file", "line"])


def overlapping(ranges: DataFrame, touched: DataFrame) -> DataFrame:
    """Ranges (file, start, end, and more) with a touched line inside."""
    return intervals.touched_ranges(ranges, touched)


def diff_coverage(added: DataFrame, hits: DataFrame, least: float = MIN_DIFF_COVERAGE, shown: int = 20) -> DataFrame:
    """One row: covered and total executable added lines (file, line), their rate (1 without any), fails, first uncovered."""
    both = added.join(hits, ["file", "line"])
    bare = both.where("hits = 0").orderBy("file", "line").limit(shown).agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("l"))
    bare = bare.select(F.transform("l", lambda x: F.concat_ws(":", x["file"], x["line"])).alias("uncovered"))
    sums = both.agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("total"))
    rate = F.coalesce(F.try_divide("covered", "total"), F.lit(1.0))
    return sums.withColumn("rate", rate).withColumn("fails", rate < least).join(bare)


def uncovered_files(added: DataFrame, hits: DataFrame) -> DataFrame:
    """Changed files without any coverage data."""
    return added.select("file").distinct().join(hits.select("file").distinct(), "file", "left_anti")
