"""Review questions: which a hunk raises, what text goes with them, and what an answer means."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import ordering
from gristmill.functions import patterns as P


#: Rules of the settings that one query takes.
MOST_RULES = 200
#: Lines and labels that an automaton is built for at a time.
LINE_BLOCK, LABEL_PART = 10_000, 50_000


def questions(hunks: DataFrame, triggers: dict[str, str] | None = None) -> DataFrame:
    """file, at, question for each trigger that a hunk's added text (file, at, text) has.

    Metrics count in dashboards only, a provider's own file may branch on it, and every line of an update
    path counts.
    """
    named = triggers or P.TRIGGERS
    text, file = F.col("text"), F.col("file")
    more = {
        "metric_without_deeplink": lambda hit: hit & (file.rlike(P.DASHBOARD) | text.rlike(P.DASHBOARD)),
        "per_vendor_branch": lambda hit: hit & ~file.rlike(P.PROVIDER_FILE),
        "update_without_rollback": lambda hit: hit | (file.rlike(P.UPDATE_PATH) & text.rlike(r"\S")),
    }
    raised = F.array(*(F.when(more.get(q, lambda hit: hit)(text.rlike(p)), F.lit(q)) for q, p in named.items()))
    return hunks.select("file", "at", F.explode(F.array_compact(raised)).alias("question"))


def file_kinds(files: DataFrame, globs: dict[str, list[str]]) -> DataFrame:
    """file, kinds: which of the kinds (ux, i18n, code, prompt) a file is by their globs; tests and test support are none."""
    other = F.col("file").rlike(P.test_file_regex()) | F.col("file").rlike(P.TEST_SUPPORT)
    found = F.array_compact(F.array(*(F.when(F.col("file").rlike("|".join(map(P.glob_regex, g))), F.lit(k)) for k, g in globs.items() if g)))
    return files.select("file", F.when(other, F.array().cast("array<string>")).otherwise(found).alias("kinds"))


def long_text(text: Column) -> Column:
    """Whether a line shows a text of ten words of prose or more: in quotes or between tags."""
    shown = F.array_append(F.regexp_extract_all(text, F.lit(P.QUOTED), F.lit(2)), F.regexp_extract(text, P.BETWEEN_TAGS, 1))
    return F.exists(shown, lambda t: prose_words(t) >= P.PLAIN_WORDS)


def asked_questions(lines: DataFrame, off: list[str] | None = None) -> DataFrame:
    """file, hunk_ord, question, at: what a hunk's added lines (file, hunk_ord, line, text, kinds) raise, and the first line that does.

    A question reads the kinds of file that it is about. ``off`` names questions that are not asked; a name that
    is none is an error. One pass over the lines: a minimum for each question, then its rows.
    """
    if unknown := sorted(set(off or []) - P.QUESTION_KINDS.keys()):
        raise ValueError(f"unknown question id(s) {', '.join(unknown)}")
    text, file = F.col("text"), F.col("file")
    is_kind = lambda *k: F.arrays_overlap("kinds", F.array(*map(F.lit, k)))
    hit = {q: text.rlike(P.TRIGGERS[q]) for q in P.QUESTION_KINDS if q in P.TRIGGERS}
    hit |= {
        "untranslated_text": text.rlike(P.TEXT_IN_QUOTES),
        "jargon_in_ui": F.when(is_kind("i18n"), text.rlike(P.TEXT_IN_QUOTES)).otherwise(text.rlike(P.TRIGGERS["jargon_in_ui"])),
        "text_not_plain": long_text(text),
        "per_vendor_branch": hit["per_vendor_branch"] & ~file.rlike(P.PROVIDER_FILE),
        "update_without_rollback": F.when(file.rlike(P.UPDATE_PATH), text.rlike(r"\S")).otherwise(hit["update_without_rollback"]),
        "prompt_depends_on_environment": F.when(is_kind("prompt"), text.rlike(P.PROMPT_REFERENCE)).otherwise(hit["prompt_depends_on_environment"]),
    }
    names = [q for q in P.QUESTION_KINDS if q not in (off or [])]
    firsts = [F.min(F.when(hit[q] & is_kind(*P.QUESTION_KINDS[q]), F.col("line"))).alias(q) for q in names]
    by = lines.groupBy("file", "hunk_ord").agg(*firsts, F.max(text.rlike(P.DASHBOARD)).alias("_dashboard"))
    shown = {q: F.col(q) for q in names}
    if "metric_without_deeplink" in shown:
        shown["metric_without_deeplink"] = F.when(file.rlike(P.DASHBOARD) | F.col("_dashboard"), F.col("metric_without_deeplink"))
    rows = by.select("file", "hunk_ord", F.explode(F.array(*(F.struct(F.lit(q).alias("question"), c.alias("at")) for q, c in shown.items()))).alias("x"))
    return rows.select("file", "hunk_ord", "x.question", "x.at").where("at is not null")


def spec_request(changed_files: DataFrame, spec: str | None, readable: bool, scope: str = "change") -> DataFrame:
    """One row at most, (request, line): whether the change is held against a specification, or why it is not."""
    any_file = changed_files.limit(1)
    if scope == "all":
        any_file = any_file.where(F.lit(False))
    line = "spec not set" if not spec else None if readable else f"spec not readable ({spec})"
    return any_file.select(F.lit(None if line else "spec_incomplete").cast("string").alias("request"), F.lit(line).cast("string").alias("line"))


def stem(file: Column) -> Column:
    """A file's name before the first point, in lower case, without what marks a test."""
    return F.regexp_replace(F.lower(F.regexp_extract(file, r"([^/.]*)[^/]*\z", 1)), r"^test_|_test\z|_spec\z", "")


def tests_for(sources: DataFrame, tests: DataFrame, limit: int) -> DataFrame:
    """source, ord, text: test hunks (file, ord, text) for each source (file), those of the same stem first, as long as they fit.

    Of the other tests only the first ones that fit the limit by themselves can be among them; these are one
    row of at most ``limit`` characters, which meets every source. Tests of the same stem are joined by it.
    """
    named = tests.select("ord", stem(F.col("file")).alias("stem"), F.concat("file", F.lit("\n"), "text").alias("text"))
    some = packed(named.withColumn("doc", F.lit(0)), limit).agg(F.collect_list(F.struct("ord", "stem", "text")).alias("all"))
    own = sources.select(F.col("file").alias("doc"), stem(F.col("file")).alias("stem")).distinct()
    first = own.join(named, "stem").select("doc", F.struct(F.lit(0).alias("p"), "ord").alias("ord"), "text")
    other = own.join(some).select("doc", F.col("stem").alias("_s"), F.explode("all").alias("x")).where("x.stem <> _s")
    rows = first.unionByName(other.select("doc", F.struct(F.lit(1).alias("p"), F.col("x.ord").alias("ord")).alias("ord"), F.col("x.text").alias("text")))
    return packed(rows, limit).select(F.col("doc").alias("source"), "ord", "text")


def test_questions(hunks: DataFrame, errors_added: DataFrame) -> DataFrame:
    """file, at, question of test hunks (file, at, added, removed, mocks): what their added code gives rise to.

    Error paths are asked about when the change's code (one row, errors) adds any.
    """
    flag = F.broadcast(errors_added.select(F.col("errors").alias("_e")))
    ask = F.array_compact(
        F.array(
            F.lit("textual_test"), F.when(F.col("_e"), F.lit("error_path_tested")), F.when((F.col("added") != "") & (F.col("removed") != ""), F.lit("assertion_weakened")),
            F.when(F.col("mocks"), F.lit("mock_hides_behavior")), F.when(F.col("added").rlike(P.TRIGGERS["property_is_tautology"]), F.lit("property_is_tautology")),
        )
    )
    return hunks.join(flag).select("file", "at", F.explode(ask).alias("question"))


def project_questions(hunks: DataFrame, rules: DataFrame) -> DataFrame:
    """file, at, question from a table of rules (question, glob pattern, trigger).

    The rules are settings: they become one array, of ``MOST_RULES`` at most, that every hunk is held against.
    """
    held = rules.select("question", "glob", "trigger").limit(MOST_RULES + 1).collect()
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} project questions")
    asked = F.array(*(F.when(F.col("file").rlike(r["glob"]) & F.col("text").rlike(r["trigger"]), F.lit(r["question"])) for r in held)).cast("array<string>")
    return hunks.select("file", "at", F.explode(F.array_compact(asked)).alias("question"))


def noted(verdicts: DataFrame, limits: DataFrame) -> DataFrame:
    """Verdicts (question, file, p) at or over their question's limit, or under it where ``below`` is set."""
    both = verdicts.join(limits, "question")
    return both.where(F.when(F.col("below"), F.col("p") < F.col("limit")).otherwise(F.col("p") >= F.col("limit"))).select("question", "file", "p")


def first_requests(requests: DataFrame, most: int) -> DataFrame:
    """The first requests (ord, has_pack): those with pack questions before plain ones."""
    return requests.orderBy(F.desc("has_pack"), "ord").limit(most)


CUT = "\n[... cut ...]"


def clip(text: Column, limit: Column) -> Column:
    """A text of at most ``limit`` characters that ends in a mark, or in as much of it as fits, if it was longer."""
    room = F.greatest(limit - F.lit(len(CUT)), F.lit(0)).cast("int")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, room), F.left(F.lit(CUT), limit.cast("int"))))


def clipped(items: DataFrame, limit: int) -> DataFrame:
    """Items (doc, ord, text) as long as a JSON list of them fits the limit."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(F.to_json(F.array("text"))) - 2 + 1
    return items.withColumn("_s", F.sum(size).over(w)).where(F.col("_s") + 2 <= limit).drop("_s")


def packed(items: DataFrame, limit: int) -> DataFrame:
    """Items as long as they fit, with three characters between them; the one that crosses the limit is clipped."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    left = limit - F.coalesce(F.sum(F.length("text") + 3).over(w), F.lit(0))
    return items.withColumn("_l", left).where(F.col("_l") > 0).withColumn("text", clip(F.col("text"), F.col("_l"))).drop("_l")


def fitted(states: DataFrame, limit: int, fields: list[str]) -> DataFrame:
    """States whose last field is clipped so that the fields together fit the limit as JSON."""
    size = F.length(F.to_json(F.struct(*fields)))
    last = fields[-1]
    over = F.greatest(size - limit, F.lit(0))
    return states.withColumn(last, F.when(over > 0, clip(F.col(last), F.greatest(F.length(last) - over - 2, F.lit(0)))).otherwise(F.col(last)))


def note_lines(verdicts: DataFrame) -> DataFrame:
    """note of verdicts (question, p, below, limit, file, at, label)."""
    side = F.when(F.col("below"), "<").otherwise(">=")
    place = F.when(F.col("at") > 0, F.concat_ws(":", "file", "at")).otherwise(F.col("file"))
    return verdicts.withColumn("note", F.concat(F.lit("note: "), F.col("question"), F.lit(" p="), F.format_number("p", 2), F.lit(" "), side, F.lit(" "), F.col("limit").cast("string"), F.lit("  "), place, F.lit("  "), F.col("label")))


def failure_line(failures: DataFrame, total: int) -> DataFrame:
    """One row, line: why requests (ord, reason) failed; the reason alone if all failed for it."""
    one = failures.agg(F.count("*").alias("n"), F.count_distinct("reason").alias("kinds"), F.min_by("reason", "ord").alias("first")).where("n > 0")
    line = F.when((F.col("n") == total) & (F.col("kinds") == 1), F.col("first")).otherwise(F.concat(F.col("n").cast("string"), F.lit(f" of {total} request(s): "), F.col("first")))
    return one.select(F.concat(F.lit("not available ("), line, F.lit(")")).alias("line"))


def summaries(changed: DataFrame) -> DataFrame:
    """file, added, removed lines of a change."""
    return changed.groupBy("file").agg(F.count_if(F.col("side") == "+").alias("added"), F.count_if(F.col("side") == "-").alias("removed"))


def ordered_files(files: DataFrame, is_test: Column, is_source: Column) -> DataFrame:
    """file, bucket, n: sources (0), others (1), tests (2), by name in each, numbered from 1."""
    bucket = F.when(is_test, 2).when(is_source, 0).otherwise(1)
    placed = ordering.sums_before(files.select("file", bucket.alias("bucket")), ["bucket", "file"])
    return placed.select("file", "bucket", (F.col("before") + 1).alias("n"))


def prose_words(text: Column) -> Column:
    """Number of words of letters, as in running text."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(P.PROSE_WORD)))


def duplicate_labels(lines: DataFrame, most: int = 10) -> DataFrame:
    """file, line, label, same: added controls whose label other lines of the file (file, line, text, added) hold.

    Any text holds a label that stands somewhere in it; labels have two characters at least. ``same`` has the
    first ``most`` of these lines, as (line, text). Rows with a null file, line or text hold none.
    """
    label = F.regexp_extract("text", P.CONTROL_LABEL, 1)
    controls = lines.where("added").select("file", "line", label.alias("label")).where("length(label) > 1")
    # One more than are shown, as a control's own line may be among them.
    n = F.row_number().over(Window.partitionBy("file", "label").orderBy("line", "text"))
    first = lines_with(lines, controls.select("file", "label").distinct(), most + 1).withColumn("_n", n).where(F.col("_n") <= most + 1)
    shown = first.groupBy("file", "label").agg(F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("text", r"^\s+|\s+\z", "").alias("text")))).alias("_s"))
    other = F.slice(F.filter("_s", lambda x: x["line"] != F.col("line")), 1, most)
    # A filter over both sides goes behind an explode: Spark pushed it to one side.
    same = F.when(F.size(other) > 0, other)
    return controls.join(shown, ["file", "label"]).select("file", "line", "label", F.explode(F.array(same)).alias("same")).where("same is not null")


def lines_with(lines: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """file, label, line, text: lines (file, line, text) that hold a label (file, label) of their file, at most the first ``most`` of each label in a block.

    A file of more than ``LINE_BLOCK`` lines goes in several blocks, dealt by hash, and its labels, if many, in parts
    of about ``LABEL_PART``. An automaton of a part's labels reads each block once, so a file costs its text times
    its parts. Files follow each other in a task, which holds one automaton and one batch of lines.
    """
    rows = lines.where("file is not null and line is not null and text is not null").select("file", "line", "text")
    # Few files have several blocks or parts: at most one for each LINE_BLOCK lines or LABEL_PART labels.
    # Names of their own, as all sides come from the same lines.
    many = lambda x, size, file, name: F.broadcast(x.groupBy("file").agg(F.ceil(F.count("*") / size)).toDF(file, name).where(f"{name} > 1"))
    blocks, parts = many(rows, LINE_BLOCK, "_f", "_blocks"), many(labels, LABEL_PART, "_g", "_parts")
    one = lambda n: F.coalesce(n, F.lit(1)).alias(n)
    sized = lambda x: x.join(blocks, F.col("file") == F.col("_f"), "left").join(parts, F.col("file") == F.col("_g"), "left").select(*x.columns, one("_blocks"), one("_parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = sized(rows).withColumn("_block", F.pmod(F.xxhash64("line", "text"), F.col("_blocks"))).withColumn("_part", each("_parts")).withColumn("_kind", F.lit(1))
    offered = sized(labels.select("file", F.col("label").alias("text"))).withColumn("_block", each("_blocks")).withColumn("_part", F.pmod(F.xxhash64("text"), F.col("_parts")))
    offered = offered.withColumn("_kind", F.lit(0)).withColumn("line", F.lit(None).cast(rows.schema["line"].dataType))
    keys = ["file", "_block", "_part"]
    dealt = asked.select(*keys, "_kind", "line", "text").unionByName(offered.select(*keys, "_kind", "line", "text")).repartition(*keys).sortWithinPartitions(*keys, "_kind", "line", "text")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, seen, made = None, None, Counter(), False
        for batch in batches:
            at: list[int] = []
            found: list[str] = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "_kind", "text")]
            for i, (file, block, part, kind, text) in enumerate(zip(*columns, strict=True)):
                if group != (file, block, part):
                    group, automaton, seen, made = (file, block, part), None, Counter(), False
                if kind == 0:
                    automaton = automaton or ahocorasick.Automaton()
                    automaton.add_word(text, text)
                elif automaton is not None:
                    if not made:
                        automaton.make_automaton()
                        made = True
                    for x in {x for _, x in automaton.iter(text)}:
                        if seen[x] < most:
                            seen[x] += 1
                            at.append(i)
                            found.append(x)
            if at:
                hit = batch.select(["file", "line", "text"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([hit.column(0), pa.array(found, pa.string()), hit.column(1), hit.column(2)], ["file", "label", "line", "text"])

    return dealt.mapInArrow(held, f"file {types['file']}, label string, line {types['line']}, text string")


def component_references(exports: DataFrame, lines: DataFrame) -> DataFrame:
    """file, name, n, used: exported components (file, name), how many lines (file, text) of other files name them, and whether one uses them.

    An import, a re-export or a bare name in a list of imports names a component and does not use it; neither
    does a test. Lines and components meet by word.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))))
    rows = lines.select(F.col("file").alias("_f"), word.alias("name"), (~F.col("text").rlike(P.IMPORT_ONLY) & ~F.col("file").rlike(P.test_file_regex())).alias("_used"))
    other = exports.select("file", "name").distinct().join(rows, "name").where("_f <> file").groupBy("file", "name").agg(F.count("*").alias("n"), F.bool_or("_used").alias("used"))
    return exports.select("file", "name").distinct().join(other, ["file", "name"], "left").select("file", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("used", F.lit(False)).alias("used"))


def unwired(exports: DataFrame, lines: DataFrame) -> DataFrame:
    """file, name of exported components (file, name) that no line (file, text) of another file uses."""
    return component_references(exports, lines).where("not used").select("file", "name")


def first_behaviour(text: Column) -> Column:
    """The first line of an added text that does something: no import, type, comment or closer; null without one.

    A declaration lasts until its braces are closed; lines are folded with the depth of those that are open.
    """
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    seen = F.transform(F.split(text, "\n", -1), lambda t: F.struct(t.alias("t"), (count(t, "{") - count(t, "}")).alias("turn"), t.rlike(P.DECLARATION).alias("opens"), t.rlike(P.IDLE_LINE).alias("idle")))

    def step(held: Column, line: Column) -> Column:
        typed = (held["depth"] > 0) | line["opens"]
        depth = F.when(typed, F.greatest(held["depth"] + line["turn"], F.lit(0))).otherwise(0)
        return F.struct(depth.alias("depth"), F.coalesce(held["first"], F.when(~typed & ~line["idle"], line["t"])).alias("first"))

    return F.aggregate(seen, F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("first")), step)["first"]


def untested_hunks(hunks: DataFrame) -> DataFrame:
    """file, at, first: hunks (file, at, text) with behaviour, and its first line."""
    return hunks.select("file", "at", first_behaviour(F.col("text")).alias("first")).where("first is not null")


# Shell commands that skip hooks. Words end in WORD and commands in COMMAND, which no text holds afterwards.
WORD, COMMAND = "\x1f", "\x1e"
TOKEN = r"""#[^\n]*|(?:\\[\s\S]?|'[^']*+'?|"(?:[^"\\]|\\[\s\S])*+"?|[^\s;&|()'"\\])+|[;&|()\n]"""
PART = r"""\\[\s\S]?|'[^']*+'?|"(?:[^"\\]|\\[\s\S])*+"?|[^'"\\]+"""


def shell_commands(text: Column) -> Column:
    """Commands of a shell text, each as its words with ``WORD`` after every one; quotes and escapes are taken off.

    Separators, line ends and comments end a command.
    """
    clean = F.regexp_replace(text, f"[{WORD}{COMMAND}]", " ")

    def plain(part: Column) -> Column:
        inner = F.regexp_replace(part, r"""^["']|(?<=[\s\S])["']\z""", "")
        return F.when(part.startswith("'"), inner).when(part.startswith('"'), F.regexp_replace(inner, r"\\([\s\S])", "$1")).when(part.startswith("\\"), F.substr(part, F.lit(2))).otherwise(part)

    def word(token: Column) -> Column:
        ends = token.rlike(r"^(?:#[\s\S]*|[;&|()\n])\z")
        return F.when(ends, F.lit(COMMAND)).otherwise(F.concat(F.array_join(F.transform(F.regexp_extract_all(token, F.lit(PART), F.lit(0)), plain), ""), F.lit(WORD)))

    joined = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0)), word), "")
    return F.filter(F.split(joined, COMMAND), lambda c: c != "")


def _words(*alternatives: str) -> str:
    return f"(?:{'|'.join(alternatives)}){WORD}"


ANY = f"[^{WORD}]*{WORD}"
#: ``git`` as the command, or after one that runs another.
GIT = f"^(?:[A-Za-z_][A-Za-z0-9_]*={ANY})*+(?:(?:[^{WORD}]*/)?git{WORD}|(?=(?:{'|'.join(P.COMMAND_RUNNERS)}){WORD})(?>(?:{ANY})*?(?:[^{WORD}]*/)?git{WORD}))"
VALUED = _words(*P.GIT_VALUED_OPTIONS)
OPTION = f"(?:{VALUED}(?:{ANY})?+|(?!{VALUED})-{ANY})"
HOOKS_PATH = "(?i:core\\.hookspath)"
BY_OPTION = f"{GIT}{OPTION}*?(?:(?:-c|--config){WORD}|-c|--config=){HOOKS_PATH}(?:=|{WORD})"
BY_CONFIG = f"{GIT}{OPTION}*config{WORD}(?:{ANY})*?{HOOKS_PATH}(?:=|{WORD})"
COMMIT_VALUED = _words(*P.COMMIT_VALUED_OPTIONS)
BEFORE = f"(?:{COMMIT_VALUED}(?:{ANY})?+|(?!{COMMIT_VALUED}|--{WORD}){ANY})*?"
#: Letters of a group of short options before n, none of which takes the rest as its value.
BY_FLAG = f"{GIT}{OPTION}*(?:(commit){WORD}{BEFORE}(--no-verify|-(?!-)[^{WORD}mFtcCn]*n[^{WORD}]*){WORD}|(push){WORD}{BEFORE}(--no-verify){WORD})"


def bypass_reason(command: Column) -> Column:
    """How one command (as ``shell_commands`` gives it) skips hooks; null if it does not."""
    part = lambda i: F.regexp_extract(command, BY_FLAG, i)
    said = F.concat(F.lit("git "), part(1), part(3), F.lit(" "), part(2), part(4), F.lit(" skips verification hooks"))
    return (
        F.when(command.rlike(BY_OPTION), "git -c core.hooksPath changes the configured hooks")
        .when(command.rlike(BY_CONFIG), "git config core.hooksPath changes the configured hooks")
        .when(command.rlike(BY_FLAG), said)
    )


def hook_bypasses(commands: DataFrame) -> DataFrame:
    """ord, reason of shell texts (ord, text) that skip hooks: that of the first command that does; a null text skips none."""
    reasons = F.transform(shell_commands(F.col("text")), bypass_reason)
    return commands.select("ord", F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0)).alias("reason")).where("reason is not null")


def occurrences(text: Column, find: str) -> Column:
    """How often a string stands in a text, overlaps included."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(find)})"))
