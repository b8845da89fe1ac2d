"""Folders that change as a whole: written beside, then renamed.

What is new is written to a folder of its own first; only when all of it is
there, renames put it in its place. A writer that dies before leaves what
stood there; one that dies between its two renames leaves it beside, and
``recover``, which readers and writers call first, puts it back. Renames are
atomic where the file system's are: on HDFS and local disks, not on object
stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _rename(spark: SparkSession, old: str, new: str) -> None:
    files, hadoop = _files(spark, old)
    if not files.rename(hadoop(old), hadoop(new)):
        raise OSError(f"cannot rename {old} to {new}")


def recover(spark: SparkSession, path: str) -> str:
    """``path``, with what stood there put back if a writer died between its renames."""
    path = path.rstrip("/")
    files, hadoop = _files(spark, path)
    old = hadoop(f"{path}._old")
    if not files.exists(hadoop(path)) and files.exists(old):
        files.rename(old, hadoop(path))
    return path


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``path`` becomes what ``write`` has put into the folder that it is given; readers of the old one may finish before.

    ``write`` may read ``path``.
    """
    path = recover(spark, path)
    files, hadoop = _files(spark, path)
    staged, old = f"{path}._staged-{uuid.uuid4().hex}", f"{path}._old"
    try:
        write(staged)
        files.delete(hadoop(old), True)
        if files.exists(hadoop(path)):
            _rename(spark, path, old)
        _rename(spark, staged, path)
    finally:
        files.delete(hadoop(staged), True)
    files.delete(hadoop(old), True)


def append_once(spark: SparkSession, path: str, batch: str, write: Callable[[str], None]) -> bool:
    """Add ``path``/batch=<batch> as a whole; False, and nothing done, if that batch is there already."""
    files, hadoop = _files(spark, path)
    target = hadoop(f"{path}/batch={batch}")
    if files.exists(target):
        return False
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    try:
        write(staged)
        # Of two writers of a batch the second's rename fails or, on some file systems, moves into the first's folder under a hidden name.
        return bool(not files.exists(target) and files.rename(hadoop(staged), target))
    finally:
        files.delete(hadoop(staged), True)
