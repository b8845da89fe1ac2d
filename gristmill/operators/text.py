"""Detectors over lines of text: secrets, redaction, glossary, prose, doc links, commit messages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.phrases import first_phrases, sizes_of


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def allow_reason(text: Column) -> Column:
    """The reason after an allow mark; null without one."""
    reason = F.trim(F.regexp_extract(text, P.ALLOW_MARK, 1))
    return F.when(reason != "", reason)


def machine_path(text: Column, users: list[str] | None = None) -> Column:
    """The first home folder that is not a placeholder's; null without one."""
    names = "|".join(re.escape(u) for u in [*P.PLACEHOLDER_USERS, *(users or [])])
    found = F.regexp_extract(text, rf"(?<![\w.$])/(?:Users|home)/(?!(?:{names})/)[A-Za-z][\w.-]*/", 0)
    return F.when(found != "", found)


def secret_findings(added: DataFrame, users: list[str] | None = None) -> DataFrame:
    """rule, file, line, allowed of added lines (file, line, text): a credential first, else a machine path.

    ``allowed`` is the reason of an inline mark, which makes a finding a notice. Environment files are found
    by name and cannot be allowed; lock files and scratch folders are not read.
    """
    text = F.col("text")
    rule = F.when(any_of(text, P.SECRETS), "secret/token").when(machine_path(text, users).isNotNull(), "secret/machine-path")
    rows = added.where(~F.col("file").rlike(P.LOCKFILES) & ~F.col("file").startswith(".scratch/")).withColumn("rule", rule).where("rule is not null")
    env = added.where(F.col("file").rlike(P.ENV_FILE)).select(F.lit("secret/env-file").alias("rule"), "file", F.lit(1).alias("line"), F.lit(None).cast("string").alias("allowed")).distinct()
    return rows.select("rule", "file", F.col("line").cast("int").alias("line"), allow_reason(text).alias("allowed")).unionByName(env)


def redact(text: Column) -> Column:
    """Credentials, then sensitive assignments, then home folders replaced."""
    for p in P.SECRETS:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return F.regexp_replace(F.regexp_replace(text, P.SENSITIVE, "$1$2[REDACTED]"), P.HOME_PATH, "/[REDACTED]/")


def prose_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line, text) of documents outside fenced blocks; the fences themselves stay."""
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    w = Window.partitionBy("file").orderBy("line")
    inside = F.pmod(F.sum(fence.cast("int")).over(w), F.lit(2)) == 1
    return lines.withColumn("_f", fence).withColumn("_in", inside).where("_f or not _in").drop("_f", "_in")


def term_pattern(terms: list[str]) -> str:
    """Whole words, whatever their case."""
    return r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{N}_])"


def glossary_findings(lines: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """rule, file, line, msg of lines with a word to avoid; the first in the line.

    A short list becomes one pattern. A table (term, ord) may have any number of terms and is looked up by an index;
    then rows with the same file and line give one finding.
    """
    if isinstance(terms, DataFrame):
        found = first_phrases(lines.select("file", "line", "text"), ["file", "line"], terms.select(F.col("term").alias("phrase"), "ord")).withColumnRenamed("phrase", "_w")
    else:
        found = lines.withColumn("_w", F.regexp_extract("text", term_pattern(terms), 1)).where("_w <> ''")
    return found.select(F.lit("glossary").alias("rule"), "file", "line", F.concat(F.lit('Avoid word "'), F.col("_w"), F.lit('"')).alias("msg"))


def avoid_terms(lines: DataFrame, marker: str, allow: DataFrame) -> DataFrame:
    """term: comma-parted words after the marker, of lines without a qualifier, that are not allowed (term)."""
    rest = F.get(F.split("text", re.escape(marker), -1), F.lit(1))
    kept = lines.where(F.col("text").contains(marker)).select(rest.alias("r")).where(~F.col("r").rlike(P.GLOSSARY_QUALIFIER))
    terms = kept.select(F.explode(F.transform(F.split("r", ",", -1), lambda x: F.trim(x))).alias("term")).where("term <> ''").distinct()
    known = allow.select(F.lower("term").alias("_t")).distinct()
    return terms.join(known, F.lower("term") == F.col("_t"), "left_anti")


def commit_body(text: Column) -> Column:
    """A commit message as it will be: cut at the scissors, without comments."""
    return F.array_join(F.filter(F.split(F.get(F.split(text, P.SCISSORS, 2), F.lit(0)), "\n", -1), lambda x: ~x.startswith("#")), "\n")


def commit_findings(messages: DataFrame) -> DataFrame:
    """doc, n_attributions, first_line of commit messages (doc, text) that name a tool as an author."""
    found = commit_notes(messages, []).groupBy("doc").agg(F.count("*").cast("int").alias("n_attributions"), F.min("line").alias("first_line"))
    return found


def commit_notes(messages: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """doc, rule, line, msg of commit messages (doc, text): a note for each kind of attribution, and for each line with a term to avoid.

    The message has the first 60 characters of what was found.
    """
    rows = messages.select("doc", commit_body(F.col("text")).alias("body"))
    one = lambda p: F.when(F.col("body").rlike(p), F.struct(line_of(F.col("body"), p).alias("line"), F.left(F.regexp_replace(F.regexp_extract("body", p, 0), r"^\s+|\s+\z", ""), F.lit(60)).alias("what")))
    said = rows.select("doc", F.explode(F.array_compact(F.array(*map(one, P.ATTRIBUTION)))).alias("x"))
    said = said.select("doc", F.lit("commit/attribution").alias("rule"), F.col("x.line").cast("int").alias("line"), F.concat(F.lit("AI/tool attribution: "), "x.what").alias("msg"))
    if isinstance(terms, list) and not terms:
        return said
    lines = rows.select("doc", F.posexplode(F.split("body", "\n", -1)).alias("line", "text")).withColumn("file", F.col("doc")).withColumn("line", F.col("line") + 1)
    return said.unionByName(glossary_findings(lines, terms).select(F.col("file").alias("doc"), "rule", F.col("line").cast("int").alias("line"), "msg"))


def line_of(text: Column, pattern: str) -> Column:
    """Number of the line on which the first match begins."""
    before = F.get(F.split(text, pattern, 2), F.lit(0))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def spans(text: Column) -> Column:
    """What stands between back quotes."""
    return F.transform(F.regexp_extract_all(text, F.lit("`([^`\n]+)`"), F.lit(1)), lambda x: F.trim(x))


def path_parts(token: Column) -> Column:
    """STRUCT<path, line>; the line is the range's last, 0 without one."""
    p = r"^(.*?)(?::([0-9]+)(?:-([0-9]+))?)?\z"
    line = F.coalesce(F.regexp_extract(token, p, 3).try_cast("int"), F.regexp_extract(token, p, 2).try_cast("int"), F.lit(0))
    return F.struct(F.regexp_replace(F.regexp_extract(token, p, 1), r"/\z", "").alias("path"), line.alias("line"))


def symbol_of(token: Column) -> Column:
    """The name in ``name()``, ``a.b()`` or lowerCamel; null for another token."""
    call = r"^([\w$.]+)\(\)\z"
    is_call = token.rlike(call)
    name = F.element_at(F.split(F.when(is_call, F.regexp_extract(token, call, 1)).otherwise(token), r"\.", -1), -1)
    return F.when(name.rlike(r"^[A-Za-z_$][\w$]*\z") & (is_call | name.rlike(r"^[a-z][a-z0-9]*[A-Z][\w$]*\z")), name)


def references(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """file, line, token, path, at, symbol, is_path of back-quoted tokens; ``roots`` (name) are the repository's first folders."""
    refs = lines.select("file", "line", F.explode(spans(F.col("text"))).alias("token")).withColumn("_p", path_parts(F.col("token")))
    refs = refs.select("file", "line", "token", "_p.path", F.col("_p.line").alias("at"), symbol_of(F.col("token")).alias("symbol"))
    shape = F.col("token").rlike(r"^[\w.@-]+(/[\w.@-]*)*(:[0-9]+(-[0-9]+)?)?\z") & ~F.col("token").startswith("@") & F.col("path").contains("/")
    known = roots.select(F.col("name").alias("_r"), F.lit(True).alias("_known")).distinct()
    first = F.get(F.split("path", "/"), F.lit(0))
    return refs.join(known, first == F.col("_r"), "left").withColumn("is_path", shape & (F.coalesce("_known", F.lit(False)) | first.isin(".", ".."))).drop("_r", "_known")


def doc_findings(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """rule, file, line, token: paths that no file (file, n_lines) has, lines beyond its end, symbols that code (name) lacks."""
    f = files.select(F.col("file").alias("path"), "n_lines")
    folder = F.regexp_replace("file", r"[^/]*\z", "")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), F.lit(1), i), "/"))).alias("path")).distinct()
    paths = refs.where("is_path").withColumn("near", F.regexp_replace(F.concat(folder, F.col("path")), r"(^|/)\./", "$1"))
    own = f.unionByName(folders.join(f, "path", "left_anti").withColumn("n_lines", F.lit(None).cast("bigint"))).withColumn("hit", F.lit(True))
    both = paths.join(own, "path", "left").join(own.select(F.col("path").alias("near"), F.col("n_lines").alias("n2"), F.col("hit").alias("hit2")), "near", "left")
    lines = F.when(F.col("hit"), F.col("n_lines")).otherwise(F.col("n2"))
    rule = F.when(F.col("hit").isNull() & F.col("hit2").isNull(), "doc/path").when((F.col("at") > 0) & (F.col("at") > lines), "doc/line")
    found = both.withColumn("rule", rule).where("rule is not null").select("rule", "file", "line", "token")
    lost = refs.where("not is_path and symbol is not null").join(symbols.select(F.col("name").alias("symbol")).distinct(), "symbol", "left_anti")
    return found.unionByName(lost.select(F.lit("doc/symbol").alias("rule"), "file", "line", "token"))


def deleted_references(lines: DataFrame, deleted: DataFrame) -> DataFrame:
    """file, line, deleted: document lines whose back-quoted tokens begin with a file that the change removes.

    Of a token's beginnings only those as long as some removed file's name are looked up, so a long token costs no
    more than its length and those names.
    """
    gone = deleted.where("file <> ''").select(F.col("file").alias("deleted")).distinct()
    tokens = lines.select("file", "line", sizes_of(gone, F.col("deleted")).alias("_sizes"), F.explode(spans(F.col("text"))).alias("token"))
    begins = F.transform(F.filter("_sizes", lambda n: n <= F.length("token")), lambda n: F.left("token", n))
    prefixes = tokens.select("file", "line", F.explode(begins).alias("deleted"))
    return prefixes.join(gone, "deleted", "left_semi").select("file", "line", "deleted").distinct()


def removed_files(status: DataFrame) -> DataFrame:
    """file of status rows (status, file, new_file) that delete a file or rename it away."""
    return status.where(F.left("status", F.lit(1)).isin("D", "R")).select("file").distinct()


def live_documents(files: DataFrame, globs: list[str], history: list[str]) -> DataFrame:
    """Documents (file) by the globs, without those that record history."""
    named = lambda g: F.col("file").rlike("|".join(map(P.glob_regex, g))) if g else F.lit(False)
    return files.where(named(globs) & ~named(history))


def known_symbols(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """name: the words of code (file, text), documents left out, that are among the wanted names (name); each once."""
    words = lines.where(~F.col("file").endswith(".md")).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w$]+"), F.lit(0)))).alias("name"))
    return words.join(wanted.select("name").distinct(), "name", "left_semi").distinct()


def document_check(lines: DataFrame, documents: DataFrame, roots: DataFrame, files: DataFrame, code: DataFrame, all_lines: DataFrame, removed: DataFrame) -> DataFrame:
    """rule, file, line, token of all that is wrong with documents: added lines (file, line, text) of live documents that name what is not there, and any of their lines (``all_lines``) that name a removed file.

    ``documents`` are the live ones (file); ``code`` has the lines of code (file, text) that symbols are looked up in.
    """
    own = lines.join(documents.select("file").distinct(), "file", "left_semi")
    refs = references(own, roots)
    names = refs.where("not is_path and symbol is not null").select(F.col("symbol").alias("name")).distinct()
    found = doc_findings(refs, files, known_symbols(code, names))
    gone = deleted_references(all_lines.join(documents.select("file").distinct(), "file", "left_semi"), removed)
    return found.unionByName(gone.select(F.lit("doc/deleted").alias("rule"), "file", "line", F.col("deleted").alias("token")))
