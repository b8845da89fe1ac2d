"""Joins of ranges of lines with lines, without comparing all of a file.

A range is cut into the aligned blocks of 1, 16, 256, ... lines that cover it
exactly, at most 30 of a size, and a line lies in one block of each size. So
"which ranges hold this line" is an equality join on file, size and block,
with each pair met once and none in vain; only sizes that some range has room for are
looked up. Whether a range holds any line at
all needs no pairs: ranges and lines are read together, from the last line
to the first, and each range sees the next line from its start on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.ordering import dealt, saved
from gristmill.functions.scan import Scan

#: Blocks grow by 2**BITS; the largest have 2**TOP lines.
BITS, TOP = 4, 28
SIZES = range(0, TOP + 1, BITS)
#: A range is seldom more blocks than that.
MOST = 60
_NONE = "array<struct<level:int,block:bigint>>"


def cover(start: Column, end: Column) -> Column:
    """The blocks that make up the lines from ``start`` to ``end``, as STRUCT<level, block>; none if a bound is null or they are reversed."""
    start, end = start.cast("long"), end.cast("long")

    def some(shift: int) -> Column:
        # Blocks of this size inside the range are those from ``low`` to before ``high``; larger ones take the middle.
        low, high = F.shiftright(start + ((1 << shift) - 1), shift), F.shiftright(end + 1, shift)
        wide = 1 << BITS
        middle, after = F.shiftright(low + (wide - 1), BITS) * wide, F.shiftright(high, BITS) * wide
        apart = (middle < after) & F.lit(shift < TOP)
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        blocks = F.when(apart, F.concat(run(low, middle), run(after, high))).otherwise(run(low, high))
        return F.transform(blocks, lambda b: F.struct(F.lit(shift).alias("level"), b.alias("block")))

    return F.when((start <= end), F.concat(*(some(s) for s in SIZES))).otherwise(F.array().cast(_NONE))


def sizes_in_use(ranges: DataFrame, start: Column, end: Column) -> tuple[list[int], int]:
    """The sizes of block that the longest range has room for, and about how many blocks all ranges are."""
    return _sizes(ranges, start, end)[:2]


def _sizes(ranges: DataFrame, start: Column, end: Column) -> tuple[list[int], int, int]:
    """``sizes_in_use``, and how many ranges there are."""
    length = end.cast("long") - start.cast("long") + 1
    found = ranges.agg(F.coalesce(F.max(length), F.lit(0)).alias("most"), F.coalesce(F.sum(F.greatest(F.least(length, F.lit(MOST)), F.lit(0))), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    return [s for s in SIZES if found["most"] >> s > 0], found["n"], found["rows"]


def around(line: Column, sizes: Iterable[int] = SIZES) -> Column:
    """The blocks that a line lies in, one of each size."""
    return F.array(*(F.struct(F.lit(s).alias("level"), F.shiftright(line.cast("long"), s).alias("block")) for s in sizes)).cast(_NONE)


def touched_ranges(ranges: DataFrame, touched: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The rows of ``ranges`` (file, start, end, and more) that hold a touched line (file, line), as they are, repeated ones too.

    Rows with a null file or bound hold none. One file may have any share of the rows.
    """
    rows = ranges.where(F.col("file").isNotNull() & F.col(start).isNotNull())
    # Downwards: a line before the ranges that start on it.
    both = rows.select(F.col("file").alias("_file"), (-F.col(start).cast("long")).alias("_down"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_line"), F.struct("*").alias("_row"))
    lines = touched.where(F.col("file").isNotNull() & F.col("line").isNotNull()).select(F.col("file").alias("_file"), F.col("line").cast("long").alias("_line")).distinct()
    both = both.unionByName(lines.select("_file", (-F.col("_line")).alias("_down"), F.lit(0).alias("_kind"), "_line"), allowMissingColumns=True)
    found = Scan(both, ["_file"], ["_down", "_kind"]).read(lasts={"_next": F.col("_line")}).rows
    return found.where(F.col("_row").isNotNull() & (F.col("_next") <= F.col(f"_row.{end}"))).select("_row.*")


def innermost_ranges(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """file, line, name of lines (file, line): the name of the range (file, start, end, name) around each that starts last, of several the shortest.

    Each block keeps its innermost range, so ranges that lie around one another are not paired with a line.
    """
    at = F.struct("start", (-F.col("end")).alias("end"), "name")
    held = saved(ranges.select("file", "start", "end", "name"))
    blocks = cover(F.col("start"), F.col("end"))
    sizes, n = sizes_in_use(held, F.col("start"), F.col("end"))
    # A few ranges in a small shuffle may be many blocks, so they are dealt to as many tasks as these need.
    best = dealt(held, n, "file", "start", "end").select("file", "start", "end", "name", F.explode(blocks).alias("b")).groupBy("file", "b.level", "b.block").agg(F.max(at).alias("in"))
    seen = lines.select("file", "line").distinct().select("file", "line", F.explode(around(F.col("line"), sizes)).alias("b")).select("file", "line", "b.*")
    # Never a broadcast: the ranges' Parquet is far smaller than their blocks.
    found = seen.join(best.hint("merge"), ["file", "level", "block"])
    # A line has one block of each size.
    if len(sizes) > 1:
        found = found.groupBy("file", "line").agg(F.max("in").alias("in"))
    return found.select("file", "line", F.col("in.name").alias("name"))


def contained_ranges(ranges: DataFrame) -> DataFrame:
    """ord, a, b: for each range (ord, file, start, end) those that begin after its start and end with it or before."""
    blocks = cover(F.col("start") + 1, F.col("end"))
    sizes, n, rows = _sizes(ranges, F.col("start") + 1, F.col("end"))
    n += len(sizes) * rows
    outer = ranges.select("ord", "file", F.col("end").alias("_end"), F.explode(blocks).alias("x")).select("ord", "file", "_end", "x.*")
    inner = ranges.select("file", F.col("start").alias("a"), F.col("end").alias("b")).select("file", "a", "b", F.explode(around(F.col("a"), sizes)).alias("x")).select("file", "a", "b", "x.*")
    # Both sides are dealt alike, to as many tasks as the blocks need, so that none of them spills.
    keys = ["file", "level", "block"]
    return dealt(outer, n, *keys).join(dealt(inner, n, *keys).hint("merge"), keys).where("b <= _end").select("ord", "a", "b")
