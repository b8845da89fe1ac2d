"""Line coverage and function tables: LCOV, complexity CSV, complexity JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import deepjson, ordering
from gristmill.functions.scan import Scan

DA = r"^DA:(-?[0-9]+),(-?[0-9]+)(?:,.*)?\z"


def parse_lcov(lines: DataFrame, repo: str = "") -> DataFrame:
    """doc, file, line, hits from LCOV lines (doc, ord, text); hits of repeated lines are summed.

    ``repo`` is a folder that is cut from the front of paths. A report is read by ranges of its lines, so it may
    have any length; the state at a line is the last SF line.
    """
    path = F.when(F.col("text").startswith("SF:"), F.substr("text", F.lit(4)))
    if repo:
        prefix = repo.rstrip("/") + "/"
        path = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    # Other lines change nothing and tell nothing.
    kept = lines.select("doc", "ord", "text").where(F.col("text").startswith("SF:") | F.col("text").rlike(DA))
    scan = Scan(kept, ["doc"], ["ord"])
    da = scan.read(lasts={"file": path}).rows.where(F.col("text").rlike(DA)).select("doc", "file", F.regexp_extract("text", DA, 1).cast("int").alias("line"), F.regexp_extract("text", DA, 2).cast("bigint").alias("hits"))
    return ordering.dealt(da, scan.size, "doc", "file", "line").groupBy("doc", "file", "line").agg(F.sum("hits").alias("hits"))


#: The same; kept for those who call it by this name.
parse_large_lcov = parse_lcov


def valid_lcov(lines: DataFrame) -> DataFrame:
    """doc, valid: every record opens with SF, closes, and is not nested; DA lines are whole and inside; one at least.

    The state at a line is how many records have opened and closed before it.
    """
    sf, da, end = F.col("text").startswith("SF:"), F.col("text").startswith("DA:"), F.col("text") == "end_of_record"
    states = Scan(lines.select("doc", "ord", "text"), ["doc"], ["ord"]).read({"opened": sf, "closed": end}).rows
    inside = F.col("opened") > F.col("closed")
    good = F.when(sf, F.col("opened") == F.col("closed")).when(da, inside & F.col("text").rlike(DA)).when(end, inside).otherwise(~F.col("text").startswith("end_of_record"))
    return states.withColumn("good", good).groupBy("doc").agg((F.min("good") & (F.sum(da.cast("int")) > 0) & (F.sum(sf.cast("int")) == F.sum(end.cast("int")))).alias("valid"))


def csv_fields(text):
    """Fields of a quoted CSV line, with ``""`` for a quote, as an array."""
    field = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'
    quoted, bare = F.regexp_extract_all(text, F.lit(field), F.lit(1)), F.regexp_extract_all(text, F.lit(field), F.lit(2))
    return F.zip_with(quoted, bare, lambda q, b: F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(b))


def parse_complexity_csv(lines: DataFrame) -> DataFrame:
    """ord, file, name, cc, start, end of rows with eleven fields at least and a whole number as second."""
    rows = lines.select("ord", csv_fields("text").alias("f")).where((F.size("f") >= 11) & F.get("f", F.lit(1)).rlike(r"^[0-9]+\z"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("int")
    return rows.select("ord", F.get("f", F.lit(6)).alias("file"), F.get("f", F.lit(7)).alias("name"), number(1).alias("cc"), number(9).alias("start"), number(10).alias("end"))


def parse_complexity_json(texts: DataFrame) -> DataFrame:
    """file, name, cc, start, end, col of nested blocks: functions, methods and closures, not classes.

    The input (text) maps files to blocks; blocks nest to any depth, so they are walked in Python, with a
    stack. A null text has none; one that is no such JSON gives a row of nulls, but for its start of 100 characters as file.
    """

    def blocks(top: list) -> Iterator[dict]:
        stack = top[::-1]
        while stack:
            block = stack.pop()
            if isinstance(block, dict):
                yield block
                stack += [*(block.get("methods") or []), *(block.get("closures") or [])][::-1]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch["text"]:
                try:
                    top = deepjson.read(text) if text is not None else {}
                except ValueError:
                    top = None
                if not isinstance(top, dict):
                    out.append((text[:100], None, None, None, None, None))
                    continue
                for file, found in top.items():
                    for block in blocks(found) if isinstance(found, list) else ():
                        if block.get("type") != "class":
                            out.append((file, block.get("name"), block.get("complexity"), block.get("lineno"), block.get("endline"), block.get("col_offset")))
            found = pd.DataFrame(out, columns=["file", "name", "cc", "start", "end", "col"])
            yield found.astype(dict.fromkeys(["cc", "start", "end", "col"], "Int64"))

    return texts.select("text").mapInPandas(parse, "file string, name string, cc int, start int, end int, col int")


def match_messages(functions: DataFrame, messages: DataFrame) -> DataFrame:
    """functions (file, start, col, name) with cc of messages (file, line, col, cc): the n-th on a line with the n-th."""
    a = functions.withColumn("n", F.row_number().over(Window.partitionBy("file", "start").orderBy("col")))
    b = messages.withColumn("n", F.row_number().over(Window.partitionBy("file", "line").orderBy("col"))).select("file", F.col("line").alias("start"), "n", "cc")
    return a.join(b, ["file", "start", "n"]).drop("n")
