"""Paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder(path: Column) -> Column:
    """The folder of a file, empty at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?[^/]*\z", 1), r"/\z", "")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def normalized(path: Column) -> Column:
    """A path without ``.``, empty and resolvable ``..`` parts; ``.`` if nothing is left."""
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), kept).when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))

    out = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(out == "", ".").otherwise(out)


def joined(base: Column, path: Column) -> Column:
    """``path`` from the folder ``base``."""
    return normalized(F.concat_ws("/", F.nullif(base, F.lit("")), path))


def ancestors(path: Column) -> Column:
    """The folders that hold a file, deepest first, ``.`` last."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1 - i), "/"))
    return F.transform(ups, lambda d: F.when(d == "", ".").otherwise(d))


def without_script_ending(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[cm]?[jt]sx?\z", "")
