"""Associative scans: running sums and last values over groups of any length, in many tasks.

A reader of ordered lines has a state: counts so far, and values seen last.
What a range of lines does to it is a function that composes with that of the
next range. So rows are dealt by ranges of (group, order); every range is
summed up by itself; the summaries of a group's ranges, one row each, are
composed in their order to the state that each range starts with; and every
range is read again from there. One long group spreads over as many tasks as
many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import ordering

#: Rows of a range, a power of two so that no range has rows of two tasks.
BLOCK = 1 << 13
#: Rows that are dealt by ranges are whole ones: a task gets fewer of them.
RANGED = 4


class Scan:
    """``rows`` with running columns. A null in ``group`` is a group; rows with the same group and order have no order."""

    def __init__(self, rows: DataFrame, group: list[str], order: list[str]):
        ordering.ensure_checkpoints(rows.sparkSession)
        # As a struct, the key is never null, and joins find a null in it.
        # Rows are computed once, and counted from the files' ends before a task gets its share to sort.
        held = ordering.saved(rows)
        self.size = held.count()
        keyed = held.withColumn("_group", F.struct(*group))
        # Ranges of at most BLOCK rows, so that a window holds no more; they are cut from their lineage, as a sample deals the rows.
        dealt = keyed.repartitionByRange(ordering.tasks(rows.sparkSession, RANGED * self.size), "_group", *order).sortWithinPartitions("_group", *order)
        kept = ordering.saved(dealt.withColumn("_range", F.floor(F.monotonically_increasing_id() / BLOCK)))
        self._key, self._order = ["_group", "_range"], order
        # One shuffle for all that is read of the ranges: the columns go together, or each reader would shuffle its own choice of them.
        together = kept.select(*self._key, F.array(F.struct(*rows.columns)).alias("_line"))
        together = ordering.dealt(together, self.size, *self._key)
        self._rows = together.select(*self._key, F.explode(F.slice("_line", 1, 1)).alias("_line")).select(*self._key, "_line.*")
        self._here = Window.partitionBy(*self._key).orderBy(*order)
        self._ranges = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop(*self._key)

    def with_columns(self, columns: dict[str, Column]) -> Scan:
        self._rows = self._rows.withColumns(columns)
        return self

    def read(self, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> Scan:
        """Each row gets the sums over all rows of its group before it, and the last values up to itself that are not null.

        Beside a last value stand the sums before the row that it comes from, as ``<last>_<sum>``.
        """
        sums, lasts = sums or {}, lasts or {}
        zero = F.lit(0).cast("long")
        rows = self._rows.withColumns({f"_is_{c}": F.coalesce(x.cast("long"), zero) for c, x in sums.items()} | {f"_is_{c}": x for c, x in lasts.items()})
        before, upto = (self._here.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
        inside = rows.withColumns({c: F.coalesce(F.sum(f"_is_{c}").over(before), zero) for c in sums})
        seen = {c: F.struct(F.col(f"_is_{c}").alias("value"), *sums) for c in lasts}
        inside = inside.withColumns({c: F.last(F.when(F.col(f"_is_{c}").isNotNull(), x), ignorenulls=True).over(upto) for c, x in seen.items()})

        # What each range does to the state.
        if lasts:
            ends = inside.withColumn("_more", F.lead(F.lit(1)).over(self._here)).where("_more is null")
            ends = ends.select(*self._key, *((F.col(c) + F.col(f"_is_{c}")).alias(c) for c in sums), *lasts)
        else:
            ends = rows.groupBy(*self._key).agg(*(F.sum(f"_is_{c}").alias(c) for c in sums))
        start = ends.select(*self._key, *lasts, *(F.coalesce(F.sum(c).over(self._ranges), zero).alias(f"_start_{c}") for c in sums))
        moved = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.value").alias("value"), *((F.col(f"{c}.{n}") + F.col(f"_start_{n}")).alias(n) for n in sums))) for c in lasts}
        start = start.select(*self._key, *(f"_start_{c}" for c in sums), *(F.last(x, ignorenulls=True).over(self._ranges).alias(f"_start_{c}") for c, x in moved.items()))

        # The composed states, taken to the rows.
        found = inside.join(start, self._key).withColumns({c: F.coalesce(x, F.col(f"_start_{c}")) for c, x in moved.items()})
        out = {c: F.col(c) + F.col(f"_start_{c}") for c in sums} | {f"{c}_{n}": F.col(f"{c}.{n}") for c in lasts for n in sums}
        found = found.withColumns(out).withColumns({c: F.col(f"{c}.value") for c in lasts})
        self._rows = found.drop(*(f"{mark}_{c}" for c in [*sums, *lasts] for mark in ("_is", "_start")))
        return self
