"""Unified diffs as tables of files, hunks and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.patterns import WHOLE_FILE_BYTES
from gristmill.functions.scan import Scan

# The format's header of a hunk, and what stands around a file's name.
FILE_ENDS = r"^[ab]/|\t.*$"
HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def parse_diff(lines: DataFrame) -> DataFrame:
    """Changed lines of unified diffs: doc, file, deleted, hunk_ord, old_start, new_start, side, line, text.

    ``lines`` has doc (which diff), ord (line order) and text. A header is one only outside a hunk's body, so
    removed lines that begin with ``--`` stay lines. A removed line has its old number, an added one its new.
    A diff is read by ranges of its lines, so it may have any length: the state at a line is the last hunk
    header, the lines of both sides before it, and the last file names outside of bodies.
    """
    text, kind = F.col("text"), F.substring("text", 1, 1)
    part = lambda i: F.regexp_extract("text", HUNK, i)
    count = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(part(i).try_cast("int"))
    head = F.struct(part(1).try_cast("int").alias("old"), part(3).try_cast("int").alias("new"), count(2).alias("olds"), count(4).alias("news"))
    # Headers are read once, before the lines are dealt; a header begins with a sign that no line of a body has.
    read = lines.select("doc", "ord", "text", F.when(text.startswith("@@") & text.rlike(HUNK), head).alias("_at"))
    at = F.col("_at").isNotNull()
    old, new = (~at & (kind.isin(sign, " ") | (text == "")) for sign in "-+")
    found = Scan(read, ["doc"], ["ord"]).read({"_hunk": at, "_o": old, "_n": new}, {"_head": F.col("_at")})
    o, n = F.col("_o") - F.col("_head__o"), F.col("_n") - F.col("_head__n")
    found.with_columns({"_body": ~at & F.coalesce((o < F.col("_head.olds")) | (n < F.col("_head.news")), F.lit(False))})
    path = lambda p: F.when(~F.col("_body") & text.startswith(p), F.regexp_replace(F.substr("text", F.lit(5)), FILE_ENDS, ""))
    found.read(lasts={"_minus": path("--- "), "_plus": path("+++ ")})
    gone = F.col("_plus") == "/dev/null"
    return found.rows.where(F.col("_body") & kind.isin("+", "-")).select(
        "doc", F.when(gone, F.col("_minus")).otherwise(F.col("_plus")).alias("file"), gone.alias("deleted"), F.col("_hunk").alias("hunk_ord"),
        F.col("_head.old").alias("old_start"), F.col("_head.new").alias("new_start"), kind.alias("side"),
        F.when(kind == "+", F.col("_head.new") + n).otherwise(F.col("_head.old") + o).cast("int").alias("line"), F.substr("text", F.lit(2)).alias("text"), "ord",
    )


#: The same; kept for those who call it by this name.
parse_large_diff = parse_diff


def touched_lines(changed: DataFrame) -> DataFrame:
    """doc, file, line: added lines; of a hunk that only removes, the lines around the gap."""
    added = changed.where("side = '+'").select("doc", "file", "line")
    cut = changed.groupBy("doc", "file", "hunk_ord", "new_start").agg(F.max(F.col("side") == "+").alias("adds")).where("not adds")
    return added.unionByName(cut.select("doc", "file", F.explode(F.array("new_start", F.col("new_start") + 1)).alias("line"))).distinct()


def whole_files(files: DataFrame, limit: int = WHOLE_FILE_BYTES) -> DataFrame:
    """file, side, line, text of files (file, text) taken as added from their first line; larger files are left out."""
    kept = files.where(F.octet_length("text") <= limit)
    return kept.select("file", F.lit("+").alias("side"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def review_hunks(changed: DataFrame) -> DataFrame:
    """doc, file, at, text: a hunk's added lines in order, with the new line where it begins."""
    rows = changed.where("side = '+'").groupBy("doc", "file", "hunk_ord", F.col("new_start").alias("at"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def union_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Added lines (file, line, text, range_ord) of several ranges; where they meet, the later range's text."""
    both = first.unionByName(second)
    return both.groupBy("file", "line").agg(F.max_by("text", "range_ord").alias("text"))


def whole_hunks(files: DataFrame) -> DataFrame:
    """file, at, text: a new file (file, text) as one hunk, its lines marked as added."""
    return files.select("file", F.lit(1).alias("at"), F.concat(F.lit("@@ new file @@\n+"), F.regexp_replace("text", "\n", "\n+")).alias("text"))


def change_text(hunks: DataFrame, order: DataFrame) -> DataFrame:
    """doc, text: a change's hunks (doc, file, at, text) as one text, its files in order (doc, file, n)."""
    each = hunks.groupBy("doc", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rows = each.join(order, ["doc", "file"]).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("+++ b/"), "file", F.lit("\n"), "text").alias("t")))).alias("all"))
    return rows.select("doc", F.array_join(F.transform("all", lambda x: x["t"]), "\n").alias("text"))


def recent_commits(log: DataFrame, now, months: int = 12) -> DataFrame:
    """file, commits: how many commits (file, at) of the last months touched each file."""
    return log.where(F.col("at") >= F.add_months(F.lit(now).cast("timestamp"), -months)).groupBy("file").agg(F.count("*").alias("commits"))
