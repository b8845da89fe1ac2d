"""Records of package lock files, with the lines that they stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scan import Scan

VERSION = r"^[0-9][0-9A-Za-z.!+_-]*\z"


def split_spec(value: Column) -> Column:
    """STRUCT<name, version> of ``name@version``, ``@scope/name@version`` or an ``npm:`` alias; null without a version."""
    spec = F.regexp_replace(F.regexp_replace(value, r"^/", ""), r"^npm:", "")
    pattern = r"^(@[^/]*/[^\n]*|[^\n]*)@([^@]*)\z"
    name = F.regexp_extract(spec, pattern, 1)
    return F.when(spec.rlike(pattern) & (name != ""), F.struct(name.alias("name"), F.regexp_extract(spec, pattern, 2).alias("version")))


def _registry(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("version").rlike(VERSION)).select("doc", "name", "version", "line", "end", "registry")


def _read(lines: DataFrame, opens: Column | None = None, lasts: dict[str, Column] | None = None) -> Scan:
    """Lines with their number ``at``, from 1, and how many open a block up to them, ``n``.

    A lock file is read by ranges of its lines, so it may have any length.
    """
    sums = {"at": F.lit(1)} | ({} if opens is None else {"n": opens})
    found = Scan(lines.select("doc", "ord", "text"), ["doc"], ["ord"]).read(sums, lasts)
    return found.with_columns({"at": F.col("at") + 1} | ({} if opens is None else {"n": F.col("n") + opens.cast("int")}))


def _section(opens: Column, closes: Column) -> Column:
    """What a line says of the section that the next ones are in; null if nothing."""
    return F.when(opens, True).when(closes, False)


def parse_package_lock(lines: DataFrame) -> DataFrame:
    """doc, name, version, line, end, registry of npm's lock (doc, ord, text): entries two columns inside ``packages``."""
    rows = _read(lines, lasts={"indent": F.when(F.col("text").rlike(r'^\s*"packages":\s*\{'), F.length(F.regexp_extract("text", r"^(\s*)", 1)))})
    entry = r'^(\s*)"((?:[^"\\]|\\.)*)":\s*\{\s*\z'
    opens = F.col("text").rlike(entry) & (F.length(F.regexp_extract("text", entry, 1)) == F.col("indent") + 2)
    opens = F.coalesce(opens, F.lit(False))
    rows = rows.read({"n": opens}).rows.withColumn("path", F.when(opens, F.regexp_extract("text", entry, 2))).withColumn("n", F.col("n") + opens.cast("int")).where("n > 0")
    version = r'^\s*"version":\s*"([^"]+)"'
    found = rows.groupBy("doc", "n").agg(
        F.max("path").alias("path"), F.min("at").alias("line"), F.max("at").alias("until"),
        F.max_by(F.when(F.col("text").rlike(version), F.regexp_extract("text", version, 1)), F.when(F.col("text").rlike(version), F.col("at"))).alias("version"),
        F.max(F.col("text").rlike(r'^\s*"(?:resolved|integrity)":\s*"\S+"')).alias("backed"),
    )
    found = found.where(F.col("backed") & F.col("path").startswith("node_modules/"))
    name = F.element_at(F.split(F.substr("path", F.lit(14)), "/node_modules/"), -1)
    return _registry(found.select("doc", name.alias("name"), "version", "line", F.col("until").alias("end"), F.lit("npm").alias("registry")))


def parse_bun_lock(lines: DataFrame) -> DataFrame:
    """The same of a text lock whose section ``packages`` has a line for each package."""
    rows = _read(lines, lasts={"inside": _section(F.col("text").rlike(r'^\s*"packages":\s*\{'), F.col("text").rlike(r"^\s{2}\},?\s*\z"))}).rows
    pattern = r'^\s{4}"[^"]+":\s*\[\s*"((?:[^"\\]|\\.)+)"'
    hit = rows.where(F.col("inside") & F.col("text").rlike(pattern)).withColumn("spec", split_spec(F.regexp_extract("text", pattern, 1)))
    return _registry(hit.select("doc", "spec.name", "spec.version", F.col("at").alias("line"), F.col("at").alias("end"), F.lit("npm").alias("registry")))


def parse_pnpm_lock(lines: DataFrame) -> DataFrame:
    """The same of a YAML lock with two-column keys under ``packages:``; suffixes in parentheses are cut."""
    rows = _read(lines, lasts={"inside": _section(F.col("text") == "packages:", F.col("text").rlike(r"^\S"))}).rows
    pattern = r"""^\s{2}['"]?(.+?)['"]?:\s*\z"""
    hit = rows.where(F.col("inside") & F.col("text").rlike(pattern)).withColumn("spec", split_spec(F.regexp_replace(F.regexp_extract("text", pattern, 1), r"\(.+\z", "")))
    return _registry(hit.select("doc", "spec.name", "spec.version", F.col("at").alias("line"), F.col("at").alias("end"), F.lit("npm").alias("registry")))


def parse_python_lock(lines: DataFrame, require_registry: bool = False) -> DataFrame:
    """The same of ``[[package]]`` blocks; ``require_registry``: only packages whose source names a registry."""
    opens = F.trim("text") == "[[package]]"
    rows = _read(lines, opens).rows.where("n > 0")

    def value(key: str) -> Column:
        pattern = rf'^{key}\s*=\s*"([^"]+)"'
        return F.max_by(F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1)), F.when(F.col("text").rlike(pattern), F.col("at")))

    backed = F.when(F.col("text").rlike(r"^source\s*=.*\b(editable|path|git|url|virtual)\s*="), False).when(F.col("text").rlike(r"^source\s*=.*\bregistry\s*="), True)
    found = rows.groupBy("doc", "n").agg(value("name").alias("name"), value("version").alias("version"), F.min("at").alias("line"), F.max("at").alias("end"), F.max_by(backed, F.when(backed.isNotNull(), F.col("at"))).alias("backed"))
    found = found.where(F.coalesce("backed", F.lit(not require_registry)) & F.col("name").isNotNull())
    return _registry(found.select("doc", "name", "version", "line", "end", F.lit("pypi").alias("registry")))
