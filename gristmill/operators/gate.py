"""What a change has to pass: checks put together, their states, and the lines about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.operators import ratchet
from gristmill.operators.complexity import drifted
from gristmill.operators.tamper import is_project_source

FINDING = "name string, ord long, rule string, file string, line int, msg string"


def all_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """name, ord, rule, file, line, msg: findings (rule, file, line, msg) of all checks, in the order in which these are given."""
    place = F.struct("file", "line", "rule", "msg")
    parts = (df.select(F.lit(name).alias("name"), F.lit(i).cast("long").alias("ord"), "rule", "file", F.col("line").cast("int").alias("line"), "msg", place.alias("_p")) for i, (name, df) in enumerate(checks.items()))
    return reduce(DataFrame.unionByName, parts).drop("_p")


def docs_only(files: DataFrame, folders: list[str], scope: str = "change") -> DataFrame:
    """One row, docs_only: whether the changed files (file) are all documents outside the project's folders, and there are some."""
    inside = reduce(lambda a, b: a | b, (F.col("file").startswith(f"{d}/") | (F.col("file") == d) for d in folders if d != "."), F.lit("." in folders))
    plain = F.col("file").rlike(P.DOC_FILE) & ~inside
    return files.agg((F.lit(scope != "all") & (F.count("*") > 0) & F.coalesce(F.bool_and(plain), F.lit(False))).alias("docs_only"))


def escalations(files: DataFrame, globs: list[str]) -> DataFrame:
    """Changed files that always go to a reviewer."""
    if not globs:
        return files.select("file").limit(0)
    return files.where(F.col("file").rlike("|".join(map(P.glob_regex, globs)))).select("file")


def function_drift(functions: DataFrame, changed: DataFrame, baseline: DataFrame, scope: str = "change") -> DataFrame:
    """Functions (key, cc, crap) that got worse without being changed (key); a touched run judges none."""
    rows = functions.limit(0) if scope == "touched" else functions.join(changed.select("key").distinct(), "key", "left_anti")
    return drifted(rows, baseline)


def dependency_findings(cycles: DataFrame, layers: DataFrame, known_cycles: DataFrame | None, known_layers: DataFrame | None) -> DataFrame:
    """rule, file, line, msg of import cycles (key, text) and layer violations (layer) that the baseline lacks.

    A baseline without these lists is one finding of its own.
    """
    as_finding = lambda df, msg: df.select(F.lit("deps").alias("rule"), F.lit(".").alias("file"), F.lit(0).alias("line"), msg.alias("msg"))
    if known_cycles is None or known_layers is None:
        one = cycles.sparkSession.range(1)
        return as_finding(one, F.lit("deps: baseline has no dependency lists, rerun with --update-baseline"))
    new = ratchet.new_items(cycles, known_cycles, ["key"]).dropDuplicates(["key"])
    new_layers = ratchet.new_items(layers, known_layers, ["layer"])
    return as_finding(new, F.concat(F.lit("new import cycle: "), F.col("text"))).unionByName(as_finding(new_layers, F.concat(F.lit("new layer violation: "), F.col("layer"))))


def dead_code_check(items: DataFrame, known: DataFrame | None, error: Column, with_files: bool = True) -> DataFrame:
    """state, msg of unused items (kind, name): ``error``, ``no-list`` (nothing is judged) or ``new``, what the list (kind, name) lacks.

    ``error`` is the analyser's, a literal; null if it ran.
    """
    one = items.sparkSession.range(1)
    failed = one.where(error.isNotNull()).select(F.lit("error").alias("state"), error.cast("string").alias("msg"))
    if known is None:
        text = "baseline has no knip list; --update-baseline to gate dead code"
        return failed.unionByName(one.where(error.isNull()).select(F.lit("no-list").alias("state"), F.lit(text).alias("msg")))
    kept = items.where(error.isNull()) if with_files else items.where(error.isNull() & (F.col("kind") != "file"))
    new = ratchet.new_items(kept, known, ["kind", "name"]).select(F.lit("new").alias("state"), F.concat(F.lit("new unused "), F.col("kind"), F.lit(" "), F.col("name")).alias("msg"))
    return failed.unionByName(new)


def baseline_or_debt(baseline: DataFrame | None, debt: DataFrame | None) -> DataFrame | None:
    """Known items: the baseline's, or without one the debt found at the merge base; None judges nothing."""
    return debt if baseline is None else baseline


def audit_findings(now: DataFrame, known: DataFrame | None, scope: str = "change") -> DataFrame:
    """Audit findings that are new; over all files every one is."""
    return now if scope == "all" else ratchet.new_items(now, known, ratchet.ADAPTER_KEY)


def tool_runs(runs: DataFrame) -> DataFrame:
    """Analyser runs (root, kind, command, ord, ...), each command once for a root and kind: the first."""
    rest = [c for c in runs.columns if c not in ("root", "kind", "command")]
    first = runs.groupBy("root", "kind", "command").agg(F.min_by(F.struct(*rest), "ord").alias("_v"))
    return first.select("root", "kind", "command", *(F.col(f"_v.{c}").alias(c) for c in rest))


def audit_summary(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row, notice: findings over all scans, each once, and packages (null in one scan: not known); of scans (file, packages)."""
    n = ratchet.unique_findings(findings).agg(F.count("*").alias("n"))
    total = scans.agg(F.count("*").alias("scans"), F.when(~F.bool_or(F.col("packages").isNull()), F.sum("packages")).alias("packages"))
    count = F.coalesce(F.concat(F.col("packages").cast("string"), F.lit(" packages")), F.lit("package count unavailable"))
    said = F.concat(F.lit("deps/audit: "), F.col("n").cast("string"), F.lit(" finding(s) ("), count, F.lit(", osv-scanner)"))
    return n.join(total).select(F.when(F.col("scans") == 0, F.lit("not run: deps/audit (osv-scanner: no packages found)")).otherwise(said).alias("notice"))


def recovered(findings: DataFrame, second: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with those of a second scan over the files (file) whose directives hid some; each once."""
    return ratchet.unique_findings(findings.unionByName(second.join(files.select("file").distinct(), "file", "left_semi").select(*findings.columns)))


# Tests of a change


def no_test_check(files: DataFrame, tests: DataFrame, messages: DataFrame, folders: list[str]) -> DataFrame:
    """kind, msg: a finding if project sources (file) change and no test (file) is selected; a note if a message (ord, text) accepts that.

    No row where there is nothing to say.
    """
    state = files.agg(F.coalesce(F.bool_or(is_project_source(F.col("file"), folders)), F.lit(False)).alias("changed")).join(tests.agg(F.count("*").alias("tests")))
    reason = F.nullif(F.trim(F.regexp_extract("text", P.NO_TEST, 1)), F.lit(""))
    said = messages.select("ord", reason.alias("reason")).where("reason is not null").agg(F.min_by("reason", "ord").alias("reason"))
    open_ = state.join(said).where("changed and tests = 0")
    note = F.concat(F.lit("note: bypass tamper/no-tests-ran (commit-msg): "), F.col("reason"))
    return open_.select(
        F.when(F.col("reason").isNull(), "finding").otherwise("note").alias("kind"),
        F.coalesce(note, F.lit("source changed, no test touched or found; add/refer a test or qg:no-test <reason>")).alias("msg"),
    )


def red_text(failed: Column, code: Column) -> Column:
    """How red a run of tests is; null counts are unknown."""
    return F.coalesce(F.concat(failed.cast("string"), F.lit(" failed")), F.concat(F.lit("exit "), code.cast("string"), F.lit(", failed count not found in tests.log")))


def tests_line(scope: Column, skipped: Column, invalid: Column, used: Column, removed: Column, code: Column, failed: Column, lcov: Column, last_run: Column) -> Column:
    """What became of the tests, in one line; ``last_run`` is STRUCT<written, commit> or null."""
    run = F.concat(F.lit("exit "), code.cast("string"), F.lit(", failed "), F.coalesce(failed.cast("string"), F.lit("unknown")))
    held = F.when(used, F.concat(lcov, F.when(removed, F.lit(" (removed after the verdict)")).otherwise(F.lit("")))).otherwise(F.lit("none"))
    return (
        F.when(scope == "touched", F.concat(F.lit("tests: touched run "), run, F.lit(", lcov "), held))
        .when(skipped & last_run.isNotNull(), F.concat(F.lit("tests: not run (last full run "), last_run["written"], F.lit(", "), F.left(last_run["commit"], F.lit(8)), F.lit(")")))
        .when(invalid, F.concat(F.lit("tests "), run, F.lit(", invalid coverage (CRAP and mean not judged; complexity only)")))
        .when(~used, F.lit("tests: not run, no fresh lcov (CRAP and mean not judged; complexity only)"))
        .otherwise(F.concat(F.lit("tests "), run))
    )


def percent(share: Column) -> Column:
    """A share as whole per cent, halves upwards; ``no data`` for null."""
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit("no data"))


def coverage_line(covered: Column, total: Column, least: Column) -> Column:
    """Coverage of executable added lines; full where there are none."""
    rate = F.coalesce(F.try_divide(covered, total), F.lit(1.0)) * 100
    return F.concat(F.lit("cov/diff: "), F.format_string("%.1f", rate), F.lit("% ("), covered.cast("string"), F.lit("/"), total.cast("string"), F.lit(" executable added lines, minimum "), F.format_string("%.0f", least * 100), F.lit("%)"))


def preflight_problem(timed_out: Column, seconds: Column, error: Column, code: Column, ran: Column, failed: Column) -> Column:
    """Why tests cannot judge a mutant: their run on the original bytes has to pass and to run one at least; null if it does."""
    return (
        F.when(timed_out, F.concat(F.lit("timed out after "), seconds.cast("string"), F.lit("s")))
        .when(error.isNotNull(), F.concat(F.lit("cannot be read: "), error))
        .when((code != 0) | (failed > 0), F.concat(F.lit("fail on the original bytes (exit "), code.cast("string"), F.lit(", "), failed.cast("string"), F.lit(" failed)")))
        .when(ran == 0, F.lit("no test ran"))
    )


# Pushes


def pushed_commits(commits: DataFrame) -> DataFrame:
    """sha, ord of the pushed ranges' commits (range_ord, ord, sha), each once, where it comes first."""
    place = F.struct("range_ord", "ord")
    return commits.groupBy("sha").agg(F.min(place).alias("ord"))


def pushed_findings(rows: DataFrame) -> DataFrame:
    """Findings of all pushed commits (FINDING columns and ord), each line once, where it comes first."""
    return rows.groupBy(*ratchet.FINDING).agg(F.min("ord").alias("ord"))


def tree_problem(pushed: DataFrame, tests: DataFrame, dirty: DataFrame, head: str, shown: int = 10) -> DataFrame:
    """One row, problem: why touched tests do not judge the push; null if they do.

    ``pushed`` has ord, ref, commit, file of pushed files; a ref that adds none does not count. The tree must be
    the commit of every such ref, and hold no uncommitted change (file) of a pushed file or a test.
    """
    short = lambda c: F.left(c, F.lit(7))
    at = F.concat(F.lit("pushing "), short(F.col("commit")), F.lit(" ("), F.col("ref"), F.lit("), this checkout is at "), F.lit(head[:7]))
    other = pushed.where(F.col("commit") != head).agg(F.min_by(at, "ord").alias("other"))
    read = pushed.select("file").unionByName(tests.select("file")).distinct()
    names = dirty.select("file").distinct().join(read, "file", "left_semi").orderBy("file").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("file")), ", ").alias("names"))
    why = F.when(F.col("other").isNotNull(), F.concat(F.lit("touched tests not run: "), F.col("other"))).when(F.col("names") != "", F.concat(F.lit("touched tests not run: uncommitted changes in files they read: "), F.col("names")))
    return other.join(names).select(why.alias("problem"))


# Reports and settings


def list_heads(items: DataFrame, most: int = 50) -> DataFrame:
    """kind, n, shown: unused items (kind, ord, name) of each list, and the first ``most`` of it in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("kind").orderBy("ord"))
    total = items.groupBy("kind").agg(F.count("*").alias("n"))
    first = items.withColumn("_n", n).where(F.col("_n") <= most).groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("shown"))
    return total.join(first, "kind").select("kind", "n", "shown")


def report_sections(scope: Column) -> Column:
    """Titles of a report's sections by scope; with touched coverage those over the whole repository have nothing to show."""
    whole = ["Drift", "Summary", "Worklist", "Hotspots", "Top 30 CRAP"]
    rows = lambda names, shown: F.array(*(F.struct(F.lit(n).alias("title"), F.lit(shown).alias("shown")) for n in names))
    return F.when(scope == "touched", F.concat(rows(["Changed functions"], True), rows(whole, False))).otherwise(rows(whole, True))


def slug(name: Column) -> Column:
    """A tool's name as part of a rule: lower case, without ``cargo``, other characters as one dash."""
    plain = F.regexp_replace(F.lower(name), r"^cargo\s+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9:+.-]+", "-"), r"^-|-\z", "")


def tool_specs(tools: DataFrame, overrides: DataFrame) -> DataFrame:
    """id, spec, binary of tools (id, spec, separator, binary) under overrides (id, value): a version is pinned, a path is run.

    A spec ends in the separator and a version.
    """
    rows = tools.join(overrides.select("id", F.nullif(F.trim("value"), F.lit("")).alias("_v")), "id", "left")
    path = F.col("_v").contains("/") | F.col("_v").contains("\\")
    name = F.regexp_extract("spec", r"^(.*?)(?:@|==)[^@=]*\z", 1)
    pinned = F.when(F.col("_v").isNotNull() & ~path, F.concat(name, F.col("separator"), F.col("_v"))).otherwise(F.col("spec"))
    return rows.select("id", pinned.alias("spec"), F.when(path, F.col("_v")).otherwise(F.coalesce("binary", "id")).alias("binary"))


def registry_urls(packages: DataFrame, registries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Packages (registry, name, version) with url, from the registry's template (registry, url) or its override; null where that is empty or none is known."""
    escaped = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    parts = F.split("name", ":")
    group, artifact = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit("")), F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.col("name"))
    rows = packages.join(registries.withColumnRenamed("url", "_u"), "registry", "left").join(overrides.withColumnRenamed("url", "_o"), "registry", "left")
    url = F.when(F.col("_u").isNotNull(), F.coalesce(F.trim("_o"), "_u"))
    for key, value in {"name": F.col("name"), "version": F.col("version"), "group": group, "artifact": artifact}.items():
        url = F.replace(url, F.lit(f"{{{key}}}"), escaped(value))
    return rows.select("registry", "name", "version", F.nullif(url, F.lit("")).alias("url"))


def classifier_target(review: DataFrame, known: DataFrame, keys: DataFrame) -> DataFrame:
    """id, provider, url, key_env, model, problem: which classifier each set of settings asks for.

    ``review`` has id, provider, url, key_env and model, null or empty where unset; ``known`` has the providers'
    defaults with ord, their order of precedence under ``auto``; ``keys`` (key_env) are set in the environment.
    """
    have = keys.select("key_env").distinct()
    best = known.join(have, "key_env", "left_semi").agg(F.min_by("provider", "ord").alias("_auto"))
    set_ = lambda c: F.nullif(F.trim(c), F.lit(""))
    asked = review.select("id", F.coalesce(set_("provider"), F.lit("auto")).alias("asked"), *(set_(c).alias(f"_{c}") for c in ("url", "key_env", "model"))).join(best)
    rows = asked.withColumn("provider", F.when(F.col("asked") == "auto", F.col("_auto")).otherwise(F.col("asked")))
    rows = rows.join(known.drop("ord"), "provider", "left")
    rows = rows.select("id", "asked", "provider", *(F.coalesce(f"_{c}", c).alias(c) for c in ("url", "key_env", "model")), F.col("url").isNotNull().alias("_known"))
    rows = rows.join(have.withColumn("_have", F.lit(True)), "key_env", "left")
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"review.{c}")) for c in ("url", "key_env", "model"))))
    problem = (
        F.when(F.col("provider").isNull(), "no key of a known provider is set")
        .when(~F.col("_known") & (F.col("provider") != "custom"), F.concat(F.lit("unknown review.provider "), F.col("asked")))
        .when(F.size(lacks) > 0, F.concat(F.lit("review.provider = custom needs "), F.array_join(lacks, ", ")))
        .when(F.col("_have").isNull(), F.concat(F.col("key_env"), F.lit(" is not set")))
    )
    return rows.select("id", "provider", "url", "key_env", "model", problem.alias("problem"))
