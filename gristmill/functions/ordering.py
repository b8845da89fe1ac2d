"""Global order without a window over all rows in one task."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task sorts.
TASK = 1_000_000


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the session's, or one of our own where all runs in one process; an error elsewhere."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="gristmill-")
    spark.sparkContext.setCheckpointDir(found)


def saved(rows: DataFrame) -> DataFrame:
    """``rows`` cut from their lineage: as Parquet in the checkpoint folder, which takes less room there than a checkpoint."""
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def tasks(spark: SparkSession, n: int) -> int:
    """As many tasks as ``n`` rows need that are sorted in memory: their bytes in a shuffle may be few."""
    return max(min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // TASK))


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, which are ``n``, by the hash of keys."""
    return rows.repartition(tasks(rows.sparkSession, n), *keys)


def sums_before(rows: DataFrame, order: list[str | Column], n: Column | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``n`` (1 unless given) over all rows that come before in the order.

    Rows are dealt by ranges of the order and summed up in each range; only one sum for each range meets the
    others. The ranges are cut from their lineage, as they are drawn by a sample.
    """
    ensure_checkpoints(rows.sparkSession)
    dealt = rows.withColumn("_n", F.lit(1) if n is None else n).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum("_n").alias("_all"))
    starts = sums.select("_range", F.coalesce(F.sum("_all").over(until(Window.orderBy("_range"))), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(until(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    # One row for each range.
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn("before", F.col("_start") + F.col("_inside")).drop("_n", "_range", "_inside", "_start")
