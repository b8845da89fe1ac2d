"""Reports of analyzers as findings: rule, file, line, msg."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import deepjson
from gristmill.functions import patterns as P
from gristmill.operators.text import redact

SARIF = "runs array<struct<results:array<struct<ruleId:string,message:struct<text:string,markdown:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"
OSV = "results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<struct<id:string>>>>>>"
CLIPPY = "reason string, message struct<code:struct<code:string>,message:string,spans:array<struct<file_name:string,line_start:int,is_primary:boolean>>>"
MACHETE = "crates array<struct<manifest_path:string,package_name:string,unused:array<string>>>"
DEADCODE = "array<struct<Path:string,path:string,Name:string,Funcs:array<struct<Name:string,Position:struct<File:string,Line:int>>>>>"
GO_LIST = "array<struct<ImportPath:string,DepsErrors:array<struct<ImportStack:array<string>,Err:string>>,Error:struct<ImportStack:array<string>,Err:string>>>"
GITLEAKS = "RuleID string, File string, StartLine int, Commit string"
#: Strings, borders between objects, and all else, one after another.
JSON_PARTS = r"""\"(?:[^"\\]|\\[\s\S])*+"|\}\s*\{|[^"}]++|[\s\S]"""
NOT_JSON = "a text is not the analyser's JSON"


def findings(rows: DataFrame, rule: Column, file: Column, line: Column, msg: Column) -> DataFrame:
    """A missing file is ``.``, a missing line 0; URIs are decoded and lose ``file://`` and ``./``."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(file, F.lit(".")), r"^file://", ""), r"^\./", "")
    path = F.when(path.contains("%"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    return rows.select(rule.alias("rule"), path.alias("file"), F.coalesce(line.try_cast("int"), F.lit(0)).alias("line"), msg.alias("msg"))


def parse_sarif(texts: DataFrame, prefix: str) -> DataFrame:
    """Results of SARIF runs; a text without runs is an error."""
    value = F.from_json("text", SARIF)
    runs = texts.select(F.explode(F.when(value["runs"].isNull(), F.raise_error(F.lit("SARIF output has no runs array")).cast("array<struct<results:array<struct<ruleId:string,message:struct<text:string,markdown:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>")).otherwise(value["runs"])).alias("run"))
    r = runs.select(F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    rule = F.lit(prefix) if prefix in ("deps/cycle", "deps/audit") else F.concat(F.lit(prefix + "/"), F.coalesce("r.ruleId", F.lit("finding")))
    return findings(r, rule, at["artifactLocation"]["uri"], at["region"]["startLine"], F.coalesce("r.message.text", "r.message.markdown"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else."""
    return F.coalesce(F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})) == 1, F.lit(False))


def json_or_error(text: Column) -> Column:
    """The text if it is JSON; another one, but for null, is an error, as a report that cannot be read is no clean one."""
    return F.when(text.isNull() | is_json(text), text).otherwise(F.raise_error(F.lit(NOT_JSON)).cast("string"))


def json_values(text: Column, schema: str) -> Column:
    """An array from a JSON array, one object, or objects one after another.

    A closing brace before an opening one parts objects only outside strings, so strings are read as they are.
    """
    trimmed = F.trim(text)
    parts = F.regexp_extract_all(trimmed, F.lit(JSON_PARTS), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\}\s*\{\z"), F.lit("},{")).otherwise(p)), "")
    return F.from_json(F.when(trimmed.startswith("["), trimmed).otherwise(F.concat(F.lit("["), joined, F.lit("]"))), schema)


def parse_go_cycles(texts: DataFrame) -> DataFrame:
    """Import cycles, each once."""
    pkg = texts.select(F.explode(json_values(F.col("text"), GO_LIST)).alias("p"))
    errors = pkg.select(F.explode(F.concat(F.coalesce("p.DepsErrors", F.array().cast("array<struct<ImportStack:array<string>,Err:string>>")), F.when(F.col("p.Error").isNotNull(), F.array("p.Error")).otherwise(F.array().cast("array<struct<ImportStack:array<string>,Err:string>>")))).alias("e"))
    stack, err = F.coalesce("e.ImportStack", F.array().cast("array<string>")), F.coalesce("e.Err", F.lit("import cycle"))
    kept = errors.where((F.size(stack) > 0) | err.rlike("(?i)import cycle"))
    detail = F.when(F.size(stack) > 0, F.array_join(stack, " -> ")).otherwise(err)
    return findings(kept, F.lit("deps/cycle"), F.lit("go.mod"), F.lit(0), F.concat(F.lit("import cycle: "), detail)).distinct()


def parse_deadcode(texts: DataFrame) -> DataFrame:
    pkg = texts.select(F.explode(json_values(F.col("text"), DEADCODE.replace("path:string,", ""))).alias("p")).select("p", F.explode("p.Funcs").alias("f"))
    return findings(pkg, F.lit("dead/deadcode"), F.col("f.Position.File"), F.col("f.Position.Line"), F.concat(F.coalesce("p.Path", "p.Name", F.lit("package")), F.lit("."), F.col("f.Name"), F.lit(" is unreachable")))


def parse_gocyclo(lines: DataFrame) -> DataFrame:
    """Rows ``N package function file:line:column``."""
    p = r"^([0-9]+)\s+\S+\s+(\S+)\s+(.+):([0-9]+):([0-9]+)\z"
    hit = lines.withColumn("t", F.trim("text")).where(F.col("t").rlike(p))
    g = lambda i: F.regexp_extract("t", p, i)
    return findings(hit, F.lit("form/gocyclo"), g(3), g(4), F.concat(g(2), F.lit(" has complexity "), g(1)))


def parse_machete(texts: DataFrame) -> DataFrame:
    c = texts.select(F.explode(F.from_json(json_or_error(F.col("text")), MACHETE)["crates"]).alias("c")).select("c", F.explode("c.unused").alias("dep"))
    return findings(c, F.lit("dead/cargo-machete"), F.coalesce("c.manifest_path", F.lit("Cargo.toml")), F.lit(0), F.concat(F.coalesce("c.package_name", F.lit("crate")), F.lit(": unused dependency "), F.col("dep")))


def parse_clippy(lines: DataFrame) -> DataFrame:
    """Compiler messages with a clippy code; the primary span, else the first."""
    m = lines.where("trim(text) <> ''").select(F.from_json(json_or_error(F.col("text")), CLIPPY).alias("m")).where("m.reason = 'compiler-message' and startswith(m.message.code.code, 'clippy::')")
    spans = F.col("m.message.spans")
    span = F.coalesce(F.get(F.filter(spans, lambda s: s["is_primary"]), F.lit(0)), F.get(spans, F.lit(0)))
    return findings(m, F.concat(F.lit("form/"), F.col("m.message.code.code")), span["file_name"], span["line_start"], F.col("m.message.message"))


def parse_osv(texts: DataFrame) -> DataFrame:
    """Vulnerabilities of packages, each once."""
    r = texts.select(F.explode(F.from_json(json_or_error(F.col("text")), OSV)["results"]).alias("r")).select("r.source.path", F.explode("r.packages").alias("p")).select("path", "p.package", F.explode("p.vulnerabilities").alias("v"))
    msg = F.concat(F.coalesce("package.name", F.lit("package")), F.lit("@"), F.coalesce("package.version", F.lit("unknown")), F.lit(": "), F.coalesce("v.id", F.lit("vulnerability")))
    return findings(r, F.lit("deps/audit"), F.col("path"), F.lit(0), msg).distinct()


def parse_text(lines: DataFrame, rule: str) -> DataFrame:
    """Lines ``file:line[:column]: message``; of a cycle report also lines that name a cycle."""
    p = r"^(.+?):([0-9]+)(?::[0-9]+)?:\s*(.+)\z"
    rows = lines.withColumn("t", F.trim("text")).where("t <> ''")
    g = lambda i: F.regexp_extract("t", p, i)
    hit = findings(rows.where(F.col("t").rlike(p)), F.lit(rule), g(1), g(2), g(3))
    if rule != "deps/cycle":
        return hit
    return hit.unionByName(findings(rows.where(~F.col("t").rlike(p) & F.col("t").rlike("(?i)cycle|circular")), F.lit(rule), F.lit(None).cast("string"), F.lit(0), F.col("t")))


def parse_generic(texts: DataFrame, prefix: str) -> DataFrame:
    """Findings at any depth of JSON: objects with a message and a file, under several spellings; each once.

    A text that is no JSON gives one finding that says so, and so does one whose message, file or rule is itself
    too deep to be written out. JSON nests to any depth, so it is walked in Python, with a stack.
    """

    def first(*values):
        return next((v for v in values if v is not None), None)

    def found(value) -> Iterator[tuple]:
        stack = [value]
        while stack:
            value = stack.pop()
            if isinstance(value, list):
                stack += value
            elif isinstance(value, dict):
                place = value.get("location") if isinstance(value.get("location"), dict) else {}
                msg = value["message"] if isinstance(value.get("message"), str) else first(value.get("reason"), value.get("description"))
                file = first(value.get("file"), value.get("filePath"), value.get("filename"), value.get("path"), place.get("file"))
                if msg and file:
                    name = first(value.get("ruleId"), value.get("rule"), value.get("code"), value.get("id"), "finding")
                    line = first(value.get("line"), value.get("lineNumber"), place.get("line"), place.get("row"), 0)
                    yield (prefix if prefix == "deps/cycle" else f"{prefix}/{name}", str(file), str(line), str(msg))
                stack += value.values()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch["text"]:
                rest, at, held = (text or "").strip(), 0, []
                try:
                    while at < len(rest):
                        value, at = deepjson.read_value(rest, at)
                        held += found(value)
                except (ValueError, RecursionError):
                    held = [(f"{prefix}/unreadable", ".", "0", NOT_JSON)]
                out += held
            yield pd.DataFrame(out, columns=["rule", "file", "line", "msg"])

    rows = texts.select("text").mapInPandas(parse, "rule string, file string, line string, msg string")
    return findings(rows, F.col("rule"), F.col("file"), F.col("line"), F.col("msg")).distinct()


def json_output(text: Column, schema: str) -> Column:
    """STRUCT<rows, error>: the rows of a JSON array, of one object, or of one object a line; ``error`` if it is none of these.

    A whole text that is JSON but no array or object gives an error as well.
    """
    whole = F.trim(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    per_line = F.when((F.size(lines) > 0) & F.forall(lines, is_json), F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")))
    array = F.when(is_json(whole), F.when(whole.startswith("["), whole).when(whole.startswith("{"), F.concat(F.lit("["), whole, F.lit("]")))).otherwise(per_line)
    return F.struct(F.from_json(array, schema).alias("rows"), F.when(array.isNull(), "output is not JSON").alias("error"))


def parse_gitleaks(texts: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """kind, rule, file, line, msg of gitleaks reports (text): a ``finding``, a ``note`` where it is allowed, or an ``error``.

    A report is a JSON array; anything else is an error, and so is a null text; an empty one says nothing. A
    finding is allowed by a marker with a reason in one of its texts, or on its line (file, line, text).
    """
    whole = F.trim("text")
    parsed = is_json(whole)
    bad = F.when(F.col("text").isNull() | ~parsed, "cannot parse gitleaks report").when(~whole.startswith("["), "gitleaks report is not a JSON array")
    read = texts.select(F.when(whole == "", F.lit(None).cast("string")).otherwise(bad).alias("bad"), F.when(parsed & whole.startswith("["), F.from_json(whole, "array<string>")).alias("items"))
    errors = read.where("bad is not null").select(F.lit("error").alias("kind"), F.lit("secret/gitleaks").alias("rule"), F.lit(".").alias("file"), F.lit(0).alias("line"), F.col("bad").alias("msg"))
    found = read.select(F.explode("items").alias("item")).select(F.from_json("item", GITLEAKS).alias("r"), F.map_values(F.from_json("item", "map<string,string>")).alias("texts"))
    marks = F.filter(F.transform("texts", lambda t: F.nullif(F.trim(F.regexp_extract(t, P.GITLEAKS_ALLOW, 1)), F.lit(""))), lambda t: t.isNotNull())
    commit = F.when(F.coalesce("r.Commit", F.lit("")) != "", F.concat(F.lit(" in "), F.left("r.Commit", F.lit(12)))).otherwise(F.lit(""))
    rows = found.select(
        F.coalesce("r.File", F.lit(".")).alias("file"), F.coalesce(F.col("r.StartLine"), F.lit(0)).alias("line"),
        F.concat(F.coalesce("r.RuleID", F.lit("secret")), commit).alias("msg"), F.get(marks, F.lit(0)).alias("reason"),
    )
    if lines is not None:
        own = lines.select("file", "line", F.nullif(F.trim(F.regexp_extract("text", P.GITLEAKS_ALLOW, 1)), F.lit("")).alias("_own")).where("_own is not null").dropDuplicates(["file", "line"])
        rows = rows.join(own, ["file", "line"], "left").select("file", "line", "msg", F.coalesce("reason", "_own").alias("reason"))
    kind = F.when(F.col("reason").isNull(), "finding").otherwise("note")
    msg = F.when(F.col("reason").isNull(), F.col("msg")).otherwise(F.concat(F.lit("note: bypass secret/gitleaks (inline): "), redact(F.col("reason"))))
    return rows.select(kind.alias("kind"), F.lit("secret/gitleaks").alias("rule"), "file", F.col("line").cast("int").alias("line"), msg.alias("msg")).unionByName(errors)


def cycle_keys(cycles: DataFrame) -> DataFrame:
    """key, text of import cycles (ord, nodes): the sorted distinct nodes; of equal cycles the last text."""
    key = F.array_join(F.array_sort(F.array_distinct("nodes")), "|")
    return cycles.withColumn("key", key).groupBy("key").agg(F.max_by(F.array_join("nodes", " -> "), "ord").alias("text"))


def dead_summary(items: DataFrame) -> DataFrame:
    """kind, n, names (sorted) of unused items (kind, name)."""
    return items.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))


def packages_scanned(scans: DataFrame) -> DataFrame:
    """One row, packages: the sum of ``found N packages`` over scans (text); null if one has none."""
    from gristmill.sources.testlogs import total

    n = scans.select(total(F.col("text"), r"found ([0-9]+) packages?").alias("n"))
    return n.agg(F.when(~F.max(F.col("n").isNull()), F.sum("n")).alias("packages"))


def walked(texts: DataFrame) -> DataFrame:
    """doc, package, id, severity of all objects at any depth of audit reports (doc, text) that are of high or critical severity.

    Objects that tell their causes in ``via`` are left out for these. A report without any gives a row for each
    severity that its summary counts, with the count as package and a null id; a text that is no JSON gives a row
    whose severity is ``error``. JSON nests to any depth, so it is walked in Python, with a stack.
    """

    def objects(value, context: str = ""):
        stack = [(value, context)]
        while stack:
            here, around = stack.pop()
            if isinstance(here, list):
                stack += [(x, around) for x in reversed(here)]
            elif isinstance(here, dict):
                yield here, around
                stack += [(x, "" if k == "vulnerabilities" else around or k) for k, x in reversed(here.items())]

    def rows(text: str | None):
        try:
            value = deepjson.read(text or "")
        except ValueError:
            yield None, None, "error"
            return
        some = False
        for item, context in objects(value):
            level = str(item.get("severity") or "").lower()
            if level in ("high", "critical") and not any(isinstance(v, (dict, list)) for v in item.get("via") or [] if isinstance(item.get("via"), list)):
                named = next((item[k] for k in P.PACKAGE_KEYS if item.get(k) is not None), context) or "unknown"
                yield str(named), str(next((item[k] for k in P.ADVISORY_KEYS if item.get(k) is not None), "advisory")), level
                some = True
        summary = (value.get("metadata") or {}).get("vulnerabilities") if isinstance(value, dict) and isinstance(value.get("metadata") or {}, dict) else None
        for level in ("critical", "high") if not some and isinstance(summary, dict) else ():
            if str(summary.get(level, 0)).isdigit() and int(summary.get(level, 0)) > 0:
                yield f"{summary[level]} package(s)", None, level

    def whole(text: str | None) -> list[tuple]:
        try:
            return list(rows(text))
        except RecursionError:  # a name that is itself too deep to be written out
            return [(None, None, "error")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, *r) for d, t in zip(batch["doc"], batch["text"], strict=True) for r in whole(t)]
            yield pd.DataFrame(out, columns=["doc", "package", "id", "severity"])

    return texts.select("doc", "text").mapInPandas(parse, f"doc {texts.schema['doc'].dataType.simpleString()}, package string, id string, severity string")


def vulnerabilities(rows: DataFrame) -> DataFrame:
    """package, id, severity of high and critical rows, each once; summary rows (id null) only without details."""
    kept = rows.where(F.lower("severity").isin("high", "critical")).select("package", "id", F.lower("severity").alias("severity")).distinct()
    detailed = kept.where("id is not null")
    return detailed.unionByName(kept.where("id is null").join(detailed.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti"))
