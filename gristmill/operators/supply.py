"""Dependencies: age of versions, new packages, lock records of a change."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import commits, ordering
from gristmill.functions.intervals import touched_ranges
from gristmill.functions.patterns import MIN_RELEASE_AGE_DAYS

#: A manifest takes a task's time of so many rows.
MANIFEST = 50


def changed_records(records: DataFrame, added: DataFrame) -> DataFrame:
    """Lock records (file, name, version, line, end, registry) with an added line inside; of equal versions the last."""
    hit = touched_ranges(records, added, "line")
    return hit.groupBy("registry", "name", "version").agg(F.max_by(F.struct("file", "line"), F.struct("file", "line")).alias("_at")).select("registry", "name", "version", "_at.file", "_at.line")


def young_records(records: DataFrame, published: DataFrame, now: Column, days: float = MIN_RELEASE_AGE_DAYS) -> DataFrame:
    """Records with verdict ``young`` (and hours), ``bad-date`` or ``unknown``; the old enough are left out.

    ``published`` has key (registry:name@version) and published, a timestamp as text.
    """
    key = F.concat(F.col("registry"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"))
    rows = records.withColumn("key", key).join(published.withColumnRenamed("published", "_p"), "key", "left").withColumn("_t", F.try_to_timestamp("_p"))
    seconds = now.cast("timestamp").cast("double") - F.col("_t").cast("double")
    verdict = F.when(F.col("_p").isNull(), "unknown").when(F.col("_t").isNull(), "bad-date").when(seconds < days * 86400, "young")
    return rows.withColumns({"verdict": verdict, "hours": F.when(F.col("_t").isNotNull(), F.greatest(F.floor(seconds / 3600), F.lit(0)).cast("long"))}).where("verdict is not null").drop("_p", "_t")


def new_packages(now: DataFrame, before: DataFrame) -> DataFrame:
    """file, name of direct dependencies that were not there before."""
    return now.select("file", "name").distinct().join(before.select("file", "name").distinct(), ["file", "name"], "left_anti")


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """file, name, range of package.json texts (file, text); runtime ranges win over development ones."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    m = manifests.select("file", F.from_json("text", schema).alias("m"))
    rows = [m.select("file", F.explode(f"m.{k}").alias("name", "range"), F.lit(i).alias("i")) for i, k in enumerate(("dependencies", "devDependencies"))]
    return rows[0].unionByName(rows[1]).groupBy("file", "name").agg(F.min_by("range", "i").alias("range"))


def python_dependencies(manifests: DataFrame) -> DataFrame:
    """file, name, range of pyproject texts: PEP 621, optional and dependency groups, poetry tables; TOML is read in Python.

    A null text or one that is no TOML gives a row with a null name, and its reason as range. Reading takes long for the
    bytes that manifests have, so they are dealt by their number, which is counted first.
    """
    dealt = ordering.dealt(manifests.select("file", "text"), MANIFEST * manifests.count(), "file", "text")
    return dealt.mapInPandas(_read_manifests, "file string, name string, range string")


def _read_manifests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(file, *row) for file, text in zip(batch["file"], batch["text"], strict=True) for row in _dependencies(text)]
        yield pd.DataFrame(rows, columns=["file", "name", "range"])


def _table(value, *keys: str) -> dict:
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value if isinstance(value, dict) else {}


def _dependencies(text: str | None) -> list[tuple[str | None, str]]:
    try:
        top = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError as e:
        return [(None, f"not readable: {e}")]
    if text is None:
        return [(None, "not readable: no text")]
    lists = [_table(top, "project").get("dependencies"), *_table(top, "project", "optional-dependencies").values(), *_table(top, "dependency-groups").values(), _table(top, "tool", "uv").get("dev-dependencies")]
    specs = [m for one in lists if isinstance(one, list) for x in one if isinstance(x, str) and (m := re.match(r"\s*([A-Za-z0-9][\w.-]*)(.*)", x))]
    found = {m[1].lower(): m[2].strip() for m in specs}
    poetry = [_table(top, "tool", "poetry", k) for k in ("dependencies", "dev-dependencies")]
    poetry += [_table(top, "tool", "poetry", "group", g, "dependencies") for g in _table(top, "tool", "poetry", "group")]
    for name, value in (x for t in poetry for x in t.items() if x[0].lower() != "python"):
        found[name.lower()] = str(value if isinstance(value, str) else _table(value).get("version", ""))
    return list(found.items())


def cached_audits(lockfiles: DataFrame, cache: DataFrame) -> DataFrame:
    """Lock files (file, text, tool) with sha256 and fresh: a cached result (sha256, tool) can be reused."""
    rows = lockfiles.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    known = cache.select("sha256", "tool", F.lit(True).alias("_k")).distinct()
    return rows.join(known, ["sha256", "tool"], "left").select("file", "tool", "sha256", F.coalesce("_k", F.lit(False)).alias("fresh"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row, sha1 over names and contents (file, text), whatever their order; a null text differs from an empty one.

    Files are hashed, then the hashes of each of 4096 buckets by name, then those of the buckets.
    """
    name = F.sha1(F.col("file").cast("binary"))
    content = F.coalesce(F.sha1(F.col("text").cast("binary")), F.lit("null"))
    each = files.select(F.left(name, F.lit(3)).alias("b"), F.sha1(F.concat_ws(":", name, content).cast("binary")).alias("h"))
    digest = lambda c: F.sha1(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"))
    return each.groupBy("b").agg(digest("h").alias("h")).agg(digest(F.concat_ws(":", "b", "h")).alias("sha1"))


def fresh(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row, fresh: whether coverage was measured on these very files: the stored sha1 is theirs."""
    return fingerprint(files).join(stored.select(F.col("sha1").alias("_s")).limit(1), how="left").select(F.coalesce(F.col("sha1") == F.col("_s"), F.lit(False)).alias("fresh"))


def lock_ages(records: DataFrame, published: DataFrame, lookups: DataFrame, now: Column, days: float = MIN_RELEASE_AGE_DAYS) -> DataFrame:
    """Lock records (ord, file, line, registry, name, version) with state: ``young``, ``old``, ``bad-date``, ``no-registry``, ``missing``, ``offline`` or ``skipped``.

    ``published`` (key, published) is the cache of dates; ``lookups`` (key, published, offline, no_registry) has
    what was asked for the rest. After the first record whose lookup was offline none is judged.
    """
    key = F.concat(F.col("registry"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"))
    cached = published.select("key", F.col("published").alias("_cached"))
    asked = lookups.select("key", F.col("published").alias("_asked"), "offline", "no_registry")
    rows = records.withColumn("key", key).join(cached, "key", "left").join(asked, "key", "left")
    date, offline = F.coalesce("_cached", "_asked"), F.col("_cached").isNull() & F.coalesce("offline", F.lit(False))
    first = rows.where(offline).agg(F.min("ord").alias("_stop"))
    at = F.try_to_timestamp(date)
    age = now.cast("timestamp").cast("double") - at.cast("double")
    state = (
        F.when(F.col("ord") == F.col("_stop"), "offline").when(F.col("ord") > F.col("_stop"), "skipped")
        .when(F.col("_cached").isNull() & F.coalesce("no_registry", F.lit(False)), "no-registry").when(date.isNull(), "missing")
        .when(at.isNull(), "bad-date").when(age < days * 86400, "young").otherwise("old")
    )
    return rows.join(first).select("ord", "file", "line", "registry", "name", "version", state.alias("state"), date.alias("published"))


def lock_age_notices(states: DataFrame) -> DataFrame:
    """notice of lock records' states: one if the registry was out of reach, else one for each ecosystem without a registry, sorted."""
    off = states.agg(F.coalesce(F.bool_or(F.col("state") == "offline"), F.lit(False)).alias("_off"))
    one = off.where("_off").select(F.lit("deps/lock-age: not checked (offline)").alias("notice"))
    none = states.where("state = 'no-registry'").select("registry").distinct().join(off.where("not _off"))
    return one.unionByName(none.select(F.concat(F.lit("deps/lock-age: not checked (no registry for "), "registry", F.lit(")")).alias("notice")))


def write_cache(published: DataFrame, states: DataFrame, path: str) -> None:
    """The cache of publication dates with those that were looked up now, in place of the old one, which may be what ``published`` reads."""
    key = F.concat(F.col("registry"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"))
    fresh_dates = states.where("published is not null and state in ('young', 'old', 'bad-date')").select(key.alias("key"), "published")
    rows = published.select("key", "published").unionByName(fresh_dates).dropDuplicates(["key"])
    commits.replace(published.sparkSession, path, lambda place: rows.write.json(place))


def push_ranges(refs: DataFrame) -> DataFrame:
    """head, base of pushed refs (text: local ref, local sha, remote ref, remote sha); deletions go, a new branch has no base."""
    p = F.split(F.trim("text"), r"\s+")
    zero = r"^0+\z"
    rows = refs.where(F.size(p) == 4).select(F.get(p, F.lit(1)).alias("head"), F.get(p, F.lit(3)).alias("base")).where(~F.col("head").rlike(zero))
    return rows.select("head", F.when(~F.col("base").rlike(zero), F.col("base")).alias("base"))
