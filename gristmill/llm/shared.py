"""Tables in the folder that all executors share, and Arrow batch limits."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch: a worker holds a few such batches.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/gristmill/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table: cuts lineage, survives lost executors."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that ``save`` made and nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._gristmill_path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def numbered(spark: SparkSession, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, counted from 0 in each group by ``order``, and ``n``, the group's number of rows.

    Rows are dealt by ranges of (group, order), so a group spreads over as many ranges as its size asks for;
    numbers start anew in each range and are moved by the counts of the group's earlier ranges. ``order`` must
    leave no ties but between rows that are alike. The result is a table in the shared folder.
    """
    dealt = save(spark, rows.repartitionByRange(group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(group, "range").agg(F.count("*").alias("size"))
    # One row for each range that a group reaches into.
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(starts, [group, "range"])
    out = save(spark, placed.withColumn("idx", F.col("start") + F.col("inside")).drop("range", "inside", "start"), "numbered")
    drop(spark, dealt)
    return out


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of text small, however long the texts are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)


ARROW = {
    "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def map_columns(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterator[dict]], schema: str) -> DataFrame:
    """``df`` through ``work``, which reads and yields batches as one list a column.

    Values stay Python's, so a long beside a null stays the integer that it is; in a pandas column both turn
    into floats, which hold 53 bits.
    """
    fields = pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


@contextmanager
def one_thread(spark: SparkSession) -> Iterator[None]:
    """Python functions that are made inside run in workers whose matrix products take one thread each."""
    environment, names = spark.sparkContext.environment, ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")
    before = {n: environment.get(n) for n in names}
    environment.update(dict.fromkeys(names, "1"))
    try:
        yield
    finally:
        for n, value in before.items():
            if value is None:
                environment.pop(n, None)
            else:
                environment[n] = value
