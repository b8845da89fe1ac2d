"""Reports of external analysers as tables: what of them belongs to a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.functions.intervals import innermost_ranges, touched_ranges
from gristmill.functions.ordering import dealt, saved
from gristmill.operators.tamper import language_of


def clone_findings(clones: DataFrame, touched: DataFrame) -> DataFrame:
    """rule, file, line, msg of clones (ord, lines, a and b: STRUCT<file, start, end>) with a touched side (file, line); of two the first.

    Both sides are ranges of one interval join.
    """
    sides = clones.select("ord", "lines", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.lit(1).alias("side"), F.col("b").alias("own"), F.col("a").alias("other")))).alias("s"))
    hit = touched_ranges(sides.select("ord", "lines", "s.own.file", "s.own.start", "s.own.end", "s"), touched)
    best = hit.groupBy("ord").agg(F.min_by(F.struct("lines", "s"), "s.side").alias("h")).select("ord", "h.lines", "h.s")
    msg = F.concat(F.col("lines").cast("string"), F.lit(" duplicated lines with "), F.col("s.other.file"), F.lit(":"), F.col("s.other.start").cast("string"), F.lit("-"), F.col("s.other.end").cast("string"))
    return best.select(F.lit("dup/jscpd").alias("rule"), F.col("s.own.file").alias("file"), F.col("s.own.start").alias("line"), msg.alias("msg"))


def language_rules() -> list[tuple[str, str]]:
    """(language, rule) of structural rules: catch rules are for languages that have a catch, tests on text are found in all."""
    return [(name, rule) for name, _, _, _ in P.LANGUAGES for rule in P.AST_GATE_RULES if rule == "textual-test" or name in P.CATCH_LANGUAGES]


def structural_findings(matches: DataFrame, touched: DataFrame) -> DataFrame:
    """rule, file, line, msg of matches (rule, file, start, end, msg) of their language's rules with a touched line (file, line)."""
    rules = matches.sparkSession.createDataFrame(language_rules(), "_language string, rule string")
    own = matches.withColumn("_language", language_of(F.col("file"))).join(F.broadcast(rules), ["_language", "rule"], "left_semi")
    hit = touched_ranges(own, touched)
    return hit.select(F.concat(F.lit("ast/"), "rule").alias("rule"), "file", F.col("start").alias("line"), "msg")


def security_notes(lines: DataFrame) -> DataFrame:
    """note of lines (file, line, text) that call eval or exec; a note, never a finding."""
    hit = lines.where(F.col("text").rlike(P.DYNAMIC_EVAL))
    return hit.select(F.concat(F.lit("note: security/semgrep dynamic-eval "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" Dynamic eval or exec requires a security review")).alias("note"))


def form_findings(messages: DataFrame, functions: DataFrame, touched: DataFrame) -> DataFrame:
    """rule, file, line, msg of form messages (rule, file, line, msg) on changed functions: the innermost around, or the line alone."""
    kept = saved(messages.where(F.col("rule").isin(*P.FORM_RULES)))
    kept = dealt(kept, kept.count(), "file", "line")
    owners = innermost_ranges(functions.select("file", "start", "end", F.struct("start", "end").alias("name")), kept)
    rows = kept.join(owners.withColumnRenamed("name", "owner").hint("merge"), ["file", "line"], "left").select(*kept.columns, "owner")
    rows = rows.withColumns({"_a": F.coalesce("owner.start", "line"), "_b": F.coalesce("owner.end", "line")})
    hit = touched_ranges(rows, touched, "_a", "_b")
    return hit.select(F.concat(F.lit("form/"), "rule").alias("rule"), "file", "line", "msg")


def functions_by_language(functions: DataFrame, roots: DataFrame, native: list[str]) -> DataFrame:
    """Functions (analyser, file, ...) by the analyser of their file's language: the native one where there is one and it read the file, else the general one.

    ``roots`` (file, root) names the files that are analysed; files without a root are left out.
    """
    rows = functions.join(roots.where("root is not null").select("file").distinct(), "file", "left_semi").withColumn("_l", language_of(F.col("file")))
    own = rows.where((F.col("analyser") == "native") & F.col("_l").isin(*native))
    rest = rows.where(F.col("analyser") == "general").join(own.select("file").distinct(), "file", "left_anti")
    return own.unionByName(rest).drop("_l")
