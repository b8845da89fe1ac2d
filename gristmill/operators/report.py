"""What a review writes: lines, reports, baselines and logs."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import commits
from gristmill.functions.patterns import LANGUAGES
from gristmill.operators.complexity import mean_risk
from gristmill.operators.ratchet import red_flags

# What a red flag means and what to check.
FLAGS = {
    "tamper": ("a green run stops proving the code works", "is the test change intended? restore it, or say why in the commit message"),
    "secret": ("a committed secret stays in git history and has to be rotated", "is it a real credential? move it to the environment or a secret store; rotate it if it was pushed"),
}
# Lock files that are audited.
AUDITED = ["package-lock.json", "bun.lock", "yarn.lock", "pnpm-lock.yaml", "uv.lock", "poetry.lock", "requirements.txt", "Cargo.lock", "go.mod", "Gemfile.lock", "composer.lock", "pubspec.lock", "packages.lock.json"]
SKIPPED = r"(^|/)(fixtures|tests?|node_modules|dist|build|target|\.scratch)/"


def finding_line() -> Column:
    """rule, place and message of a finding in one line."""
    return F.concat(F.col("rule"), F.lit("  "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("  "), F.col("msg"))


def red_flag_lines(findings: DataFrame) -> DataFrame:
    """Findings that are red flags, with line: what, why it harms, and what to check."""
    rows = red_flags(findings)
    pick = lambda i: F.when(F.col("flag") == "tamper", FLAGS["tamper"][i]).otherwise(FLAGS["secret"][i])
    return rows.withColumn("line", F.concat(F.lit("RED FLAG: "), finding_line(), F.lit(" -- "), pick(0), F.lit("; check: "), pick(1)))


def check_output(checks: DataFrame) -> DataFrame:
    """Checks (name, error, findings, notices, note) with output: the first of these that there is."""
    out = (
        F.when(F.col("error").isNotNull(), F.array(F.concat(F.col("name"), F.lit(": ERROR "), F.col("error"))))
        .when(F.size("findings") > 0, F.col("findings")).when(F.size("notices") > 0, F.col("notices")).when(F.col("note") != "", F.array("note"))
        .otherwise(F.array().cast("array<string>"))
    )
    return checks.withColumn("output", out)


def stop_lines(note: Column) -> Column:
    """Of a note only the lines of flags and of the verdict."""
    return F.filter(F.split(note, "\n"), lambda x: x.rlike(r"^(RED FLAG|FINDINGS|quality gate crashed)"))


def tool_state(runs: DataFrame) -> DataFrame:
    """Runs of analyzers (kind, n findings, code, error) with state: findings, clean, missing or failed."""
    low = F.lower("error")
    missing = ((F.col("code") == 127) & low.rlike("not found|no such file|executable")) | ((F.col("code") != 0) & low.rlike("no such command|component.+not installed|command not found|executable.+not found"))
    clean = (F.col("code") == 0) | ((F.col("kind") == "audit") & (F.col("code") == 1))
    return runs.withColumn("state", F.when(F.col("n") > 0, "findings").when(clean, "clean").when(missing, "missing").otherwise("failed"))


def mutant_target(texts: DataFrame, find: str, replace: str) -> DataFrame:
    """Texts with n, how often ``find`` stands in them, and mutant, the changed text where that is once."""
    n = F.regexp_count("text", F.lit(f"(?={re.escape(find)})"))
    return texts.withColumns({"n": n, "mutant": F.when(n == 1, F.replace("text", F.lit(find), F.lit(replace)))})


def source_files(files: DataFrame, extra: str | None = None) -> DataFrame:
    """Files of a language outside folders that hold no sources."""
    exts = "|".join(re.escape(e) for _, es, _, _ in LANGUAGES for e in es.split())
    kept = files.where(F.col("file").rlike(rf"({exts})\z") & ~F.col("file").rlike(SKIPPED))
    return kept.where(~F.col("file").rlike(extra)) if extra else kept


def audit_lockfiles(files: DataFrame) -> DataFrame:
    return files.where(F.regexp_extract("file", r"([^/]*)\z", 1).isin(*AUDITED))


def missing_baseline(items: dict[str, DataFrame]) -> DataFrame:
    """kind, unjudged: how many items of each list there is no baseline for."""
    rows = [df.agg(F.count("*").alias("unjudged")).select(F.lit(kind).alias("kind"), "unjudged") for kind, df in items.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def changes_of(scope: str, sources: dict[str, DataFrame]) -> DataFrame:
    """The change under review: ``base`` is committed, working and untracked lines, ``staged`` the index, ``since`` a range, ``all`` every file."""
    parts = {"base": ["committed", "working", "untracked"], "staged": ["index"], "since": ["range"], "all": ["files"]}
    if scope not in parts:
        raise ValueError(f"unknown scope {scope}")
    out = None
    for name in parts[scope]:
        if name in sources:
            out = sources[name] if out is None else out.unionByName(sources[name])
    if out is None:
        raise ValueError(f"no source for scope {scope}")
    return out


def write_report(findings: DataFrame, path: str, per_check: int = 200) -> None:
    """Findings (name, ord, rule, file, line, msg) as JSON, at most ``per_check`` a check, in order."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    findings.withColumn("_n", n).where(F.col("_n") <= per_check).drop("_n").orderBy("name", "ord").write.mode("overwrite").json(path)


def markdown(findings: DataFrame, title: str, per_check: int = 15, most: int = 40) -> str:
    """A report of the first findings of each check; the limits bound what comes to the driver."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    rows = findings.withColumn("_n", n).where(F.col("_n") <= per_check).orderBy("name", "ord").limit(most).select("name", finding_line().alias("line")).collect()
    out = [f"# {title}"]
    for name in dict.fromkeys(r["name"] for r in rows):
        out += [f"## {name}", *(f"- {r['line']}" for r in rows if r["name"] == name)]
    return "\n".join(out) + "\n"


def write_baseline(scored: DataFrame, dead: DataFrame, path: str, red: bool, used: bool) -> None:
    """Functions (key, line, cc, crap), their mean and dead items as tables; refused for red tests, no coverage or no functions.

    All three are replaced at once; a writer that dies leaves the old ones.
    """
    if red:
        raise ValueError("the tests are red")
    if not used:
        raise ValueError("there is no coverage")
    if scored.isEmpty():
        raise ValueError("there are no functions")

    def write(place: str) -> None:
        scored.select("key", "line", "cc", "crap").write.parquet(f"{place}/functions")
        mean_risk(scored).write.parquet(f"{place}/mean")
        dead.write.parquet(f"{place}/dead")

    commits.replace(scored.sparkSession, path, write)


def read_baseline(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The baseline's tables functions, mean and dead, all of one writer."""
    path = commits.recover(spark, path)
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("functions", "mean", "dead")}


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Verdicts or mutant outcomes, one JSON object a line, added to a log; a named ``batch`` is added once, as a whole, however often it is sent."""
    if batch is None:
        rows.write.mode("append").json(path)
    else:
        commits.append_once(rows.sparkSession, path, batch, lambda place: rows.write.json(place))


def load_config(text: str, known: dict[str, dict]) -> dict[str, dict]:
    """TOML settings over their defaults; an unknown section or key is an error."""
    out = {k: dict(v) for k, v in known.items()}
    for section, values in tomllib.loads(text).items():
        if section not in known:
            raise ValueError(f"unknown section [{section}]")
        for key, value in values.items():
            if key not in known[section]:
                raise ValueError(f"unknown key {key} in [{section}]")
            out[section][key] = value
    return out


def config_row(spark: SparkSession, config: dict[str, dict]) -> DataFrame:
    """The settings as one row of JSON by section, for joins with data."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(config.items())], "section string, settings string")


def report_lines(sections: dict[str, DataFrame], most: int = 200) -> DataFrame:
    """part, n, line: a report's sections in order, each its title and the first ``most`` of its lines (ord, line); ``none`` without any."""
    out = None
    for part, (title, lines) in enumerate(sections.items()):
        first = lines.select("ord", "line").orderBy("ord").limit(most)
        rows = first.select(F.struct(F.lit(1).alias("k"), F.col("ord").cast("long").alias("o")).alias("at"), F.concat(F.lit("- "), "line").alias("line"))
        head = lines.sparkSession.range(1).select(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("o")).alias("at"), F.lit(f"## {title}").alias("line"))
        empty = first.agg(F.count("*").alias("c")).where("c = 0").select(F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("o")).alias("at"), F.lit("none").alias("line"))
        one = head.unionByName(rows).unionByName(empty).withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    # A section is a title and at most ``most`` lines.
    return out.select("part", F.row_number().over(Window.partitionBy("part").orderBy("at")).alias("n"), "line")
