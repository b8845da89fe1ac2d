"""Chat formatting after collapsing cumulative snapshots, in native expressions only.

A log that stores a conversation after every turn holds it many times, each
a prefix of the next. Every turn has a hash of its place, role and text; the
sums of these hashes up to a turn are the rolling hash of that prefix. An
anti-join drops a conversation if its whole hash is that of a prefix of a
longer one, or of an equal one with a smaller id. The rest is rendered.

Sums are two 64-bit hashes in halves, so they never overflow. Turns are
numbered by blocks of ``BLOCK`` turn values, so that one conversation with a
large share of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Turn values that are numbered together, and turns of one rendered row at most.
BLOCK = 256
HASHES = ["a", "b", "c", "d"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, n (from 1), role, text and the rolling hash of all up to n.

    The order is turn, role, text, nulls first. Rows that repeat all four columns count once; null roles and
    texts differ from empty ones.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.where(F.col("conv_id").isNotNull()).withColumn("block", F.floor(F.coalesce("turn", F.lit(-(2**40))) / BLOCK))
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = rows.join(starts, ["conv_id", "block"]).withColumn("n", F.col("before") + F.row_number().over(inside))
    content = [F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    h1, h2 = F.xxhash64(*content), F.xxhash64(F.lit("second"), *content)
    half = F.lit(0xFFFFFFFF)
    parts = dict(zip(HASHES, (h1.bitwiseAND(half), F.shiftrightunsigned(h1, 32), h2.bitwiseAND(half), F.shiftrightunsigned(h2, 32)), strict=True))
    placed = placed.withColumns(parts)
    sums = placed.groupBy("conv_id", "block").agg(*(F.sum(h).alias(h) for h in HASHES))
    before = sums.select("conv_id", "block", *(F.coalesce(F.sum(h).over(ahead), F.lit(0)).alias(f"{h}_before") for h in HASHES))
    up_to = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    both = placed.join(before, ["conv_id", "block"])
    return both.select("conv_id", "n", "role", "text", *((F.col(f"{h}_before") + F.sum(h).over(up_to)).alias(h) for h in HASHES))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no prefix of another.

    Of equal conversations the one with the smallest id stays.
    """
    ends = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("n", *HASHES), "n").alias("end")).select("conv_id", "end.*")
    # The group of a hash is one row whatever its size: how long the longest conversation with it is, and who comes first.
    whole = ends.groupBy("n", *HASHES).agg(F.min("conv_id").alias("first"))
    inner = prefixes.join(ends.select("conv_id", F.col("n").alias("length")), "conv_id").where(F.col("n") < F.col("length")).select("n", *HASHES).distinct()
    kept = whole.join(inner, ["n", *HASHES], "left_anti")
    return kept.select(F.col("first").alias("conv_id"), F.col("n").alias("n_turns"))


def render(prefixes: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, segment (from 0), n_turns, first_turn, turns and text: rendered turns, at most ``BLOCK`` to a row.

    A null role is written as ``unknown`` and a null text as nothing.
    """
    rows = prefixes.select("conv_id", "n", "role", "text").join(kept, "conv_id")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{CLOSE}\n"))
    rows = rows.withColumn("segment", F.floor((F.col("n") - 1) / BLOCK)).withColumn("line", F.struct("n", line.alias("said")))
    grouped = rows.groupBy("conv_id", "segment", "n_turns").agg(F.min("n").alias("first_turn"), F.count("*").alias("turns"), F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select("conv_id", "segment", "n_turns", "first_turn", "turns", F.array_join("lines.said", "").alias("text"))


def format_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Render the maximal conversations of ``turns`` (conv_id, turn, role, text).

    Rows without conv_id are left out, an empty table gives no rows, other columns are ignored.
    """
    prefixes = shared.save(spark, numbered(turns), "prefixes")
    return render(prefixes, shared.save(spark, maximal(prefixes), "maximal"))
