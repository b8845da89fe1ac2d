"""Queries over import graphs, analyser reports that need care, and review requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gristmill.functions import ordering
from gristmill.operators import complexity as C
from gristmill.operators import graph as G
from gristmill.operators import report as K
from gristmill.operators import review as V
from gristmill.operators import supply as Y
from gristmill.operators import text as X
from gristmill.plans import standins as S
from gristmill.plans.cases import Book, mixed, mixed_sql, pick, pick_sql
from gristmill.sources import diffs as D
from gristmill.sources import reports as R

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Imports: a file of each order imports one module by one of these specifiers; N is the order's number.
SPECIFIERS = ["./m{n}", "../lib/l{n}.js", "#in/{n}", "@/{n}", "exact{n}", "@scope/pkg", "@scope/pkg/deep/{n}", "react", "~x/{n}/tail", "./folder{n}"]
TARGETS = ["app/src/m{n}.ts", "app/lib/l{n}.tsx", "app/internal/i{n}.ts", "shared/{n}.mts", "shared/e.ts", "pkgs/p/main.ts", "pkgs/p/src/deep/{n}.cts", None, "tails/{n}/t.js", "app/src/folder{n}/index.tsx"]
IMPORT_SIZES = {"k": len(SPECIFIERS), "how": 4}
CONFIGS = [
    ("tsconfig.base.json", '{ // shared\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["nowhere/*", "shared/*"], "exact*": ["wrong/*"], "~x/*/tail": ["tails/*/t"]}} }'),
    ("app/tsconfig.json", '{"extends": "./mid"}'), ("app/mid.json", "{'extends': '../tsconfig.base.json', }"), ("tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["other/*"]}}}'),
]
MANIFESTS = [
    ("app/package.json", '{"name": "app", "imports": {"#in/*": {"import": "./internal/i*.ts", "default": "./no"}, "#none": null}}'), ("package.json", '{"imports": {"#in/*": "./wrong/*"}}'),
    ("pkgs/p/package.json", '{"name": "@scope/pkg", "exports": {".": {"import": "./main.ts"}}, "main": "no.js"}'), ("pkgs/q/package.json", '{"name": "@scope", "main": "q.js"}'), ("node_modules/r/package.json", '{"name": "react"}'),
]


def imports(spark, d):
    rows = mixed(spark, d, **IMPORT_SIZES)
    spec = F.replace(pick(SPECIFIERS, "k"), F.lit("{n}"), F.col("id").cast("string"))
    line = F.when(F.col("how") == 0, text('import { a } from "', spec, '";')).when(F.col("how") == 1, text("const x = require('", spec, "');")).when(F.col("how") == 2, text("export * from `", spec, "`;")).otherwise(text('await import( "', spec, '")'))
    return rows.select("id", "k", text("app/src/f", F.col("id"), ".test.ts").alias("file"), line.alias("text"))


def tracked(spark, d):
    rows = mixed(spark, d, **IMPORT_SIZES)
    own = rows.select(F.replace(pick(TARGETS, "k"), F.lit("{n}"), F.col("id").cast("string")).alias("file")).where("file is not null")
    return own.unionByName(rows.select(text("app/src/f", F.col("id"), ".test.ts").alias("file"))).distinct()


def texts(spark, pairs):
    return spark.createDataFrame(pairs, "file string, text string")


def targets(spark, d):
    return G.module_targets(G.import_specifiers(imports(spark, d)), tracked(spark, d), texts(spark, CONFIGS), texts(spark, MANIFESTS))


TARGETS_SQL = f"{mixed_sql(**IMPORT_SIZES)}, r AS (SELECT id, k, replace({pick_sql(TARGETS, 'k')}, '{{n}}', id::VARCHAR) AS target FROM c WHERE k NOT IN (4, 7))"


@BOOK.query(f"WITH {TARGETS_SQL} SELECT 'app/src/f' || id || '.test.ts' AS file, target FROM r")
def module_targets(spark, d):
    return targets(spark, d).select("file", "target")


@BOOK.query(f"WITH {TARGETS_SQL} SELECT 'app/src/f' || id || '.test.ts' AS file FROM r WHERE k IN (0, 3)")
def direct_tests(spark, d):
    return G.direct_tests(targets(spark, d), tracked(spark, d).where("file rlike '^app/src/m|^shared/'"))


# A config of each part extends that of the part before; every 100th declares paths, or in each third thousand goes back to the
# end of its own chain.
CHAINS_SQL = """
WITH k AS (SELECT DISTINCT p_partkey AS k, p_partkey // 100 * 100 AS top FROM part),
w AS (SELECT k.k, t.k AS top FROM k JOIN k t ON t.k = k.top WHERE k.top // 1000 % 3 <> 2 AND (SELECT COUNT(*) FROM k x WHERE x.k BETWEEN k.top AND k.k) = k.k - k.top + 1)
SELECT 'c/' || k || '/tsconfig.json' AS file, CASE WHEN top // 100 % 2 = 0 THEN 2 ELSE 1 END AS n, 'c/' || top || '/src/*' AS first FROM w
"""


@BOOK.query(CHAINS_SQL)
def inherited_aliases(spark, d):
    k = F.col("p_partkey")
    own = text('{ "compilerOptions": { "paths": { "@/*": ["src/*"', F.when((k / 100).cast("long") % 2 == 0, ', "lib/*"').otherwise(""), "] } } }")
    loops = (k / 1000).cast("long") % 3 == 2
    body = F.when((k % 100 == 0) & ~loops, own).otherwise(text("{'extends': '../", F.when(k % 100 == 0, k + 99).otherwise(k - 1), "/tsconfig', } // on"))
    configs = S.table(spark, d, "part").select(text("c/", k, "/tsconfig.json").alias("file"), body.alias("text"))
    return G.inherited_aliases(configs).select("file", F.size("aliases").alias("n"), F.get("aliases", F.lit(0))["path"].alias("first"))


@BOOK.query("SELECT '@p/' || p_partkey AS name, 'pkgs/' || p_partkey AS dir, CASE p_size % 5 WHEN 0 THEN './e.js' WHEN 1 THEN './i.js' WHEN 2 THEN 'm.js' WHEN 3 THEN 'n.js' ELSE 'src/index' END AS entry FROM part WHERE p_partkey % 3 > 0")
def workspace_packages(spark, d):
    k = F.col("p_size") % 5
    rest = F.when(k == 0, '"exports": "./e.js", "main": "no"').when(k == 1, '"exports": {".": {"import": "./i.js", "default": "no"}}').when(k == 2, '"module": "m.js", "main": "no"').when(k == 3, '"main": "n.js"').otherwise('"private": true')
    name = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(text("@p/", F.col("p_partkey")))
    rows = S.table(spark, d, "part").select(text("pkgs/", F.col("p_partkey"), "/package.json").alias("file"), text('{"name": "', name, '", ', rest, "}").alias("text"))
    return G.workspace_packages(rows)


BINDINGS = [
    ("import {{ load, save as keep{n} }} from './m'", ["load", "keep{n}"]), ("import type {{ type Kind{n} }} from \"./k\"", ["Kind{n}"]), ("const {{ open: opened{n}, shut }} = await import('./m')", ["opened{n}", "shut"]), ("import x from './m'", []), ("import {{\n a{n},\n}}  from `react`", ["a{n}"]),
]


@BOOK.query(f"WITH {mixed_sql(k=len(BINDINGS))} SELECT id, replace(unnest({'list_value(' + ', '.join(str(b[1]) if b[1] else 'CAST([] AS VARCHAR[])' for b in BINDINGS) + ')'}[k + 1]), '{{n}}', id::VARCHAR) AS local FROM c".replace("{{n}}", "{n}"))
def import_bindings(spark, d):
    rows = mixed(spark, d, k=len(BINDINGS))
    body = F.replace(pick([b[0].replace("{{", "{").replace("}}", "}") for b in BINDINGS], "k"), F.lit("{n}"), F.col("id").cast("string"))
    return G.import_bindings(rows.select(F.col("id").alias("file"), body.alias("text"))).select(F.col("file").alias("id"), "local")


@BOOK.query(f"WITH {mixed_sql(k=4)} SELECT 't' || id || '/x.test.ts' AS file, 't' || id || CASE k WHEN 0 THEN '/m.ts' WHEN 1 THEN '/m/index.ts' ELSE '.js' END AS source FROM c WHERE k < 3")
def binding_sources(spark, d):
    rows = mixed(spark, d, k=4)
    own = text("t", F.col("id"))
    bound = rows.select(text(own, "/x.test.ts").alias("file"), F.lit("a").alias("local"), F.when(F.col("k") < 2, "./m").when(F.col("k") == 2, text("../", own, ".js")).otherwise("m").alias("specifier"))
    here = F.array(F.when(F.col("k") == 0, text(own, "/m.ts")), F.when(F.col("k") < 2, text(own, "/m/index.ts")), F.when(F.col("k") > 1, text(own, ".js")))
    return G.binding_sources(bound, rows.select(F.explode(F.array_compact(here)).alias("file"))).select("file", "source")


EXPORTS = ["export function f{n}(a) {{}}", "export async function g{n} (", "export const h{n} = async (x) => x", "export let i{n} = ({{a}}) => a", "export const j{n} = 1", "function k{n}() {{}}", "export default class L{n} {{}}"]


@BOOK.query(f"WITH {mixed_sql(a=len(EXPORTS), b=len(EXPORTS))} SELECT DISTINCT id AS file, unnest(list_filter([{pick_sql(['f', 'g', 'h', 'i', None, None, None], 'a')}, {pick_sql(['f', 'g', 'h', 'i', None, None, None], 'b')}], lambda x: x IS NOT NULL)) || id AS name FROM c")
def exported_functions(spark, d):
    rows = mixed(spark, d, a=len(EXPORTS), b=len(EXPORTS))
    line = lambda c: F.replace(pick([e.replace("{{", "{").replace("}}", "}") for e in EXPORTS], c), F.lit("{n}"), F.col("id").cast("string"))
    return G.exported_functions(rows.select(F.col("id").alias("file"), F.concat_ws("\n", line("a"), line("b")).alias("text")))


@BOOK.query(f"WITH {mixed_sql(k=5)} SELECT 't' || id || '/x.test.ts' AS file, CASE k WHEN 0 THEN 't' || id || '/harness.tsx' WHEN 1 THEN 'fix/a' || id ELSE 't' || id || '/b.json' END AS target FROM c WHERE k < 3")
def path_literals(spark, d):
    rows = mixed(spark, d, k=5)
    own = text("t", F.col("id"))
    line = F.when(F.col("k") == 0, 'run(resolve(dir, "harness.tsx"))').when(F.col("k") == 1, text("read('../fix/a", F.col("id"), "', \"it's\")")).when(F.col("k") == 2, "open(`./b.json`)").when(F.col("k") == 3, "open(`./${x}.json`)").otherwise('x("gone.ts")')
    held = F.explode(F.array(text(own, "/harness.tsx"), text("fix/a", F.col("id")), text(own, "/b.json")))
    return G.path_literals(rows.select(text(own, "/x.test.ts").alias("file"), line.alias("text")), rows.select(held.alias("file")))


STEMS = ["Panel.tsx", "b.c.ts", "d.ts", "e.py"]


@BOOK.query(f"WITH {mixed_sql(k=4)} SELECT 's' || id || '/' || {pick_sql(STEMS, 'k')} AS source, 's' || id || '/' || CASE k WHEN 0 THEN 'Panel.render.test.ts' ELSE 'b.c.x.spec.js' END AS file FROM c WHERE k < 2")
def stem_tests(spark, d):
    rows = mixed(spark, d, k=4)
    own = text("s", F.col("id"), "/")
    tests = F.array(*(text(own, t) for t in ("Panel.render.test.ts", "b.c.x.spec.js", "dd.test.ts", "e.txt")))
    return G.stem_tests(rows.select(text(own, pick(STEMS, "k")).alias("file")), rows.select(F.explode(tests).alias("file")))


SIBLINGS = {"a/x.ts": ["a/x.test.ts", "a/x.spec.ts"], "a/x.py": ["a/test_x.py", "tests/test_x.py"], "x.rs": ["x_test.rs", "tests/x.rs"], "a/X.java": ["a/XTest.java", "a/XTests.java"], "a/x.rb": ["a/x_test.rb", "a/x_spec.rb"], "a/x.dart": ["a/x_test.dart"], "a/x.md": []}


@BOOK.query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, v in SIBLINGS.items() for n in v) + ") t(source, file)")
def sibling_names(spark, d):
    rows = spark.createDataFrame([(k,) for k in SIBLINGS], "source string")
    return rows.select("source", F.explode(F.array_distinct(G.sibling_tests(F.col("source")))).alias("file"))


# Roots of languages: folders with some of these files.
ROOT_FILES = ["package.json", "Makefile", "x.cpp", "pom.xml", "build.gradle", "build.gradle.kts", "X.java", "a.py", "node_modules/package.json", "App.csproj"]
ROOT_SIZES = {"a": len(ROOT_FILES), "b": len(ROOT_FILES)}


def _has(*which: str) -> str:
    numbers = ", ".join(str(ROOT_FILES.index(w)) for w in which)
    return f"(a IN ({numbers}) OR b IN ({numbers}))"


@BOOK.query(
    f"""WITH {mixed_sql(**ROOT_SIZES)}, r AS (SELECT 'p' || id AS root, * FROM c), f AS (SELECT root, 0 AS l, 'ts' AS language FROM r WHERE {_has('package.json')} UNION ALL SELECT root, 10, 'cpp' FROM r WHERE {_has('Makefile')} AND {_has('x.cpp')}
    UNION ALL SELECT root, 4, 'java' FROM r WHERE {_has('pom.xml', 'build.gradle')} AND (NOT {_has('build.gradle.kts')} OR {_has('X.java')}) UNION ALL SELECT root, 5, 'kotlin' FROM r WHERE {_has('build.gradle.kts')} UNION ALL SELECT root, 6, 'csharp' FROM r WHERE {_has('App.csproj')}
    UNION ALL SELECT '.', 1, 'py' UNION ALL SELECT '.', 4, 'java' UNION ALL SELECT '.', 10, 'cpp')
    SELECT language, root, ROW_NUMBER() OVER (ORDER BY root <> '.', root, l) AS ord FROM f"""
)
def language_roots(spark, d):
    rows = mixed(spark, d, **ROOT_SIZES)
    file = lambda c: text("p", F.col("id"), "/", pick(ROOT_FILES, c))
    return G.language_roots(rows.select(F.explode(F.array(file("a"), file("b"))).alias("file"))).withColumn("ord", F.col("ord").cast("long"))


# Reports


LEAKS = [
    ('[{"RuleID":"r","File":"f{n}","StartLine":{n},"Commit":"0123456789abcdef"}]', "finding", "f{n}", "r in 0123456789ab"), ('[{"StartLine":{n},"RuleID":null}]', "finding", ".", "secret"),
    ('[{"RuleID":"r","File":"f{n}","StartLine":{n},"Line":"x gitleaks:allow a test key "}]', "note", "f{n}", "note: bypass secret/gitleaks (inline): a test key"), ("[]", None, None, None), ("", None, None, None),
    ('{"RuleID":"r"}', "error", ".", "gitleaks report is not a JSON array"), ("[{", "error", ".", "cannot parse gitleaks report"), (None, "error", ".", "cannot parse gitleaks report"), ('[{"RuleID":"r","File":"ok","StartLine":{n}}]', "note", "ok", "note: bypass secret/gitleaks (inline): on the line"),
]


@BOOK.query(
    f"""WITH {mixed_sql(k=len(LEAKS))}, r AS (SELECT {pick_sql([x[1] for x in LEAKS], 'k')} AS kind, 'secret/gitleaks' AS rule, replace({pick_sql([x[2] for x in LEAKS], 'k')}, '{{n}}', id::VARCHAR) AS file, CASE WHEN k IN (0, 1, 2, 8) THEN id ELSE 0 END AS line, {pick_sql([x[3] for x in LEAKS], 'k')} AS msg FROM c) SELECT * FROM r WHERE kind IS NOT NULL"""
)
def gitleaks_report(spark, d):
    rows = mixed(spark, d, k=len(LEAKS))
    body = F.replace(pick([x[0] for x in LEAKS], "k"), F.lit("{n}"), F.col("id").cast("string"))
    lines = rows.where("k = 8").select(F.lit("ok").alias("file"), F.col("id").cast("int").alias("line"), F.lit("key = 1 # gitleaks:allow on the line").alias("text"))
    return R.parse_gitleaks(rows.select(body.alias("text")), lines).withColumn("line", F.col("line").cast("long"))


JSONS = ['[{{"a": {n}}}, {{"a": 1}}]', '{{"a": {n}}}', '{{"a": {n}}}\n\n{{"a": 2}}\n', "", "no json", '{{"a": 1}}\nno', "3", None]


@BOOK.query(f"WITH {mixed_sql(k=len(JSONS))} SELECT id, CASE WHEN k = 1 THEN 1 WHEN k < 3 THEN 2 END AS n, CASE WHEN k < 3 THEN id END AS first, CASE WHEN k >= 3 THEN 'output is not JSON' END AS error FROM c")
def json_outputs(spark, d):
    rows = mixed(spark, d, k=len(JSONS))
    body = F.replace(pick([x and x.replace("{{", "{").replace("}}", "}") for x in JSONS], "k"), F.lit("{n}"), F.col("id").cast("string"))
    out = rows.select("id", R.json_output(body, "array<struct<a:long>>").alias("o"))
    n = F.size("o.rows")
    return out.select("id", F.when(n >= 0, n).alias("n"), F.get("o.rows", F.lit(0))["a"].alias("first"), "o.error")


AUDITS = [
    ('{"vulnerabilities": {"p{n}": {"severity": "High", "via": ["q"]}, "z": {"severity": "low", "name": "z"}}}', [("p{n}", "advisory", "high")]),
    ('{"vulnerabilities": {"p": {"severity": "high", "via": [{"source": {n}, "name": "deep", "severity": "critical"}]}}}', [("deep", "{n}", "critical")]),
    ('{"metadata": {"vulnerabilities": {"critical": 2, "high": 0}}}', [("2 package(s)", None, "critical")]), ("[[{\"module_name\": \"m{n}\", \"cve\": \"C-1\", \"severity\": \"critical\"}]]", [("m{n}", "C-1", "critical")]), ("{", [(None, None, "error")]), ("{}", []),
]


@BOOK.query(
    f"WITH {mixed_sql(k=len(AUDITS))} " + " UNION ALL ".join(f"SELECT id AS doc, {', '.join('NULL' if x is None else f'''replace('{x}', '{{n}}', id::VARCHAR)''' for x in row)} FROM c WHERE k = {i}" for i, (_, found) in enumerate(AUDITS) for row in found).replace("id AS doc, replace('p{n}', '{n}', id::VARCHAR), replace('advisory', '{n}', id::VARCHAR), replace('high', '{n}', id::VARCHAR)", "id AS doc, 'p' || id AS package, 'advisory' AS id, 'high' AS severity")
)
def walked_audits(spark, d):
    rows = mixed(spark, d, k=len(AUDITS))
    return R.walked(rows.select(F.col("id").alias("doc"), F.replace(pick([x[0] for x in AUDITS], "k"), F.lit("{n}"), F.col("id").cast("string")).alias("text")))


TOMLS = ['[project]\ndependencies = ["A{n}>=1", "b"]', '[dependency-groups]\ndev = ["c{n} ~=2", {include-group = "x"}]', '[tool.poetry.dependencies]\npython = "^3"\nD{n} = {version = "1", optional = true}', "not toml [", None, ""]
FOUND = [[("a{n}", ">=1"), ("b", "")], [("c{n}", "~=2")], [("d{n}", "1")], [(None, "not readable")], [(None, "not readable")], []]


@BOOK.query(" UNION ALL ".join(f"SELECT event_id AS file, {'NULL' if n is None else f'''replace('{n}', '{{n}}', event_id::VARCHAR)'''} AS name, '{r}' AS range FROM events WHERE event_id % 6 = {i}" for i, found in enumerate(FOUND) for n, r in found))
def python_manifest_cases(spark, d):
    rows = mixed(spark, d, k=len(TOMLS))
    found = Y.python_dependencies(rows.select(F.col("id").cast("string").alias("file"), F.replace(pick(TOMLS, "k"), F.lit("{n}"), F.col("id").cast("string")).alias("text")))
    return found.select(F.col("file").cast("long").alias("file"), "name", F.regexp_replace("range", r"^(not readable)[\s\S]*", "$1").alias("range"))


# Review requests


KINDS = ["ui/a.tsx", "i18n/en.ts", "agent/a.ts", "prompts/p.md", "ui/a.test.tsx", "ui/x.stories.tsx", "lib/z.ts", "agent/provider.ts", "agent/bin/x.ts"]
ADDED = [
    ("color: '#fff'", {"ui": ["hardcoded_color"], "i18n": ["untranslated_text", "jargon_in_ui"]}), ('a: "one two three four five six seven eight nine ten"', {"ui": ["text_not_plain"], "i18n": ["text_not_plain", "untranslated_text", "jargon_in_ui"]}), ("<p>Hello you</p>", {"ui": ["jargon_in_ui"]}),
    ("throw x; // catch", {"agent": ["silent_failure"]}), ("if (vendor === 'x')", {"agent": ["per_vendor_branch"], "i18n": []}), ("run bun x", {"prompts": ["prompt_depends_on_environment"]}), ("<Card>", {}), ("plain", {}),
]
QUESTION_SIZES = {"f": len(KINDS), "t": len(ADDED), "u": len(ADDED)}
KIND_OF = ["ui", "i18n", "agent", "prompts", "", "", "", "agent", "agent"]


def _asked(column: str, line: int) -> str:
    rows = [f"SELECT id, {line} AS line, '{q}' AS question FROM c WHERE {column} = {t} AND f = {f} AND NOT (f = 7 AND '{q}' = 'per_vendor_branch')" for t, (_, by) in enumerate(ADDED) for f, k in enumerate(KIND_OF) for q in by.get(k, [])]
    return " UNION ALL ".join([*rows, f"SELECT id, {line}, 'update_without_rollback' FROM c WHERE f = 8"])


@BOOK.query(f"WITH {mixed_sql(**QUESTION_SIZES)}, a AS ({_asked('t', 4)} UNION ALL {_asked('u', 9)}) SELECT id AS hunk_ord, question, MIN(line) AS first FROM a GROUP BY ALL")
def asked_questions(spark, d):
    rows = mixed(spark, d, **QUESTION_SIZES)
    globs = {"ux": ["ui/**/*.tsx", "ui/*.tsx"], "i18n": ["i18n/**"], "code": ["agent/**/*.ts"], "prompt": ["prompts/*.md"]}
    line = lambda c, n: F.struct(F.lit(n).alias("line"), pick([a[0] for a in ADDED], c).alias("text"))
    lines = rows.select(pick(KINDS, "f").alias("file"), F.col("id").alias("hunk_ord"), F.explode(F.array(line("t", 4), line("u", 9))).alias("x")).select("file", "hunk_ord", "x.*")
    kinds = V.file_kinds(lines.select("file").distinct(), globs)
    return V.asked_questions(lines.join(F.broadcast(kinds), "file")).select("hunk_ord", "question", F.col("at").alias("first"))


BODY = ["import a from 'a'", "type T = {", "  b: 1", "}", "// note", "run(x);", "export {", "})", "# c", "y = 2"]
BODY_SIZES = {"p": 10, "q": 10, "r": 10}


def _state(prefix: str, c: str, depth: str, first: str) -> str:
    """One line's step: the depth of open declarations, and the first line with behaviour."""
    return f"CASE WHEN {depth} > 0 OR {c} IN (1, 6) THEN GREATEST(0, {depth} + CASE WHEN {c} IN (1, 6) THEN 1 WHEN {c} IN (3, 7) THEN -1 ELSE 0 END) ELSE 0 END AS d{prefix}, COALESCE({first}, CASE WHEN {depth} = 0 AND {c} IN (2, 5, 9) THEN {c} END) AS f{prefix}"


@BOOK.query(f"WITH {mixed_sql(**BODY_SIZES)}, a AS (SELECT *, {_state('1', 'p', '0', 'NULL')} FROM c), b AS (SELECT *, {_state('2', 'q', 'd1', 'f1')} FROM a), g AS (SELECT *, {_state('3', 'r', 'd2', 'f2')} FROM b) SELECT id AS hunk, {pick_sql(BODY, 'f3')} AS first FROM g WHERE f3 IS NOT NULL")
def behaviour_hunks(spark, d):
    rows = mixed(spark, d, **BODY_SIZES)
    body = F.concat_ws("\n", *(pick(BODY, c) for c in BODY_SIZES))
    return V.untested_hunks(rows.select(F.lit("a.ts").alias("file"), F.col("id").alias("at"), body.alias("text"))).select(F.col("at").alias("hunk"), "first")


@BOOK.query("SELECT 'set' AS of, 'spec_incomplete' AS request, NULL AS line UNION ALL SELECT 'unset', NULL, 'spec not set' UNION ALL SELECT 'lost', NULL, 'spec not readable (a.md)'")
def spec_requests(spark, d):
    files = S.table(spark, d, "orders").select(S.order_file().alias("file"))
    cases = {"set": ("a.md", True, files, "change"), "unset": (None, False, files, "change"), "lost": ("a.md", False, files, "change"), "empty": ("a.md", True, files.limit(0), "change"), "all": ("a.md", True, files, "all")}
    out = None
    for name, (spec, readable, changed, scope) in cases.items():
        df = V.spec_request(changed, spec, readable, scope).withColumn("of", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@BOOK.query(
    """WITH t AS (SELECT event_id AS ord, event_id % 10 AS stem, length('test_m' || event_id % 10 || '.py') + 1 + event_id % 7 AS n FROM events WHERE event_id < 200), s AS (SELECT k AS stem FROM range(0, 10) r(k)),
    o AS (SELECT s.stem, ord, n, SUM(n + 3) OVER (PARTITION BY s.stem ORDER BY t.stem <> s.stem, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s, t) SELECT 'src/m' || stem || '.py' AS source, ord, LEAST(n, 400 - COALESCE(before, 0))::INTEGER AS chars FROM o WHERE COALESCE(before, 0) < 400"""
)
def tests_for_sources(spark, d):
    k = F.col("event_id") % 10
    tests = S.table(spark, d, "events").where("event_id < 200").select(text("test_m", k, ".py").alias("file"), F.col("event_id").alias("ord"), F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int")).alias("text"))
    sources = S.table(spark, d, "events").select(text("src/m", k, ".py").alias("file"))
    return V.tests_for(sources, tests, 400).select("source", F.col("ord.ord").alias("ord"), F.length("text").alias("chars"))


#: A state that fits stays whole; of one that is too long 90 characters stay, 14 of them the mark.
@BOOK.query("SELECT event_id AS id, CASE WHEN event_id % 300 <= 92 THEN repeat('x', event_id % 300) ELSE repeat('x', 76) || chr(10) || '[... cut ...]' END AS hunk FROM events")
def fitted_states(spark, d):
    rows = S.table(spark, d, "events").select("event_id", F.lit("f").alias("file"), F.repeat(F.lit("x"), (F.col("event_id") % 300).cast("int")).alias("hunk"))
    overhead = len('{"file":"f","hunk":""}')
    return V.fitted(rows, 90 + overhead + 2, ["file", "hunk"]).select(F.col("event_id").alias("id"), "hunk")


USES = ["<N{n} a />", "import N{n} from 'x'", "export {{ N{n} }} from './n'", "  N{n},", "route(N{n})", "<N{n}0 />"]


@BOOK.query(f"WITH {mixed_sql(k=len(USES), t=2)}, u AS (SELECT id % 40 AS g, COUNT(*) AS n, bool_or(k IN (0, 4) AND t = 0) AS used FROM c WHERE k < 5 AND id % 3 = 0 GROUP BY 1) SELECT 'e' || g || '.tsx' AS file, 'N' || g AS name, COALESCE(n, 0) AS n, COALESCE(used, FALSE) AS used FROM range(0, 40) r(g) LEFT JOIN u USING (g)")
def component_references(spark, d):
    rows = mixed(spark, d, k=len(USES), t=2).where("id % 3 = 0")
    n = (F.col("id") % 40).cast("string")
    lines = rows.select(text("u", F.col("id"), pick([".tsx", ".test.tsx"], "t")).alias("file"), F.replace(pick([u.replace("{{", "{").replace("}}", "}") for u in USES], "k"), F.lit("{n}"), n).alias("text"))
    exports = spark.range(40).select(text("e", F.col("id"), ".tsx").alias("file"), text("N", F.col("id")).alias("name"))
    own = exports.select("file", text("export function ", F.col("name")).alias("text"))
    return V.component_references(exports, lines.unionByName(own))


# Documents and messages


@BOOK.query(
    """WITH r AS (SELECT event_id AS line, event_id % 6 AS k, event_id % 5 AS f FROM events), l AS (SELECT * FROM r WHERE f < 3) SELECT CASE k WHEN 0 THEN 'doc/path' WHEN 1 THEN 'doc/symbol' ELSE 'doc/deleted' END AS rule, 'docs/d' || f || '.md' AS file, line,
    CASE k WHEN 0 THEN 'src/gone' || line || '.ts' WHEN 1 THEN 'lost' || line || '()' ELSE 'src/old.ts' END AS token FROM l WHERE k < 3 UNION ALL SELECT 'doc/path', 'docs/d' || f || '.md', line, 'src/old.ts:3' FROM l WHERE k = 2"""
)
def document_checks(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("line"), (F.col("event_id") % 6).cast("int").alias("k"), (F.col("event_id") % 5).cast("int").alias("f"))
    n = F.col("line").cast("string")
    said = F.when(F.col("k") == 0, text("see `src/gone", n, ".ts`")).when(F.col("k") == 1, text("call `lost", n, "()`")).when(F.col("k") == 2, text("old `src/old.ts:3`")).when(F.col("k") == 3, text("call `kept", n, "()` in `src/a.ts`")).otherwise("plain")
    file = F.when(F.col("f") < 3, text("docs/d", F.col("f"), ".md")).when(F.col("f") == 3, F.lit("docs/adr/h.md")).otherwise(F.lit("notes.txt"))
    lines = e.select(file.alias("file"), "line", said.alias("text"))
    code = e.where("k = 3").select(F.lit("src/a.ts").alias("file"), text("export const kept", n, " = 1").alias("text")).unionByName(e.where("k = 1").select(F.lit("x.md").alias("file"), text("lost", n).alias("text")))
    files = spark.createDataFrame([("src/a.ts", 10), ("docs/d0.md", 9)], "file string, n_lines bigint")
    roots = spark.createDataFrame([("src",), ("docs",)], "name string")
    status = spark.createDataFrame([("R100", "src/old.ts", "src/new.ts"), ("M", "src/a.ts", None), ("D", "src/dead.ts", None)], "status string, file string, new_file string")
    live = X.live_documents(lines.select("file").distinct(), ["docs/**/*.md"], ["docs/adr/**"])
    return X.document_check(lines, live, roots, files, code, lines, X.removed_files(status))


MESSAGES = ["fix: a\n\nCo-Authored-By: GPT <x@y>", "fix: b", "c\n# generated by codex\nrest", "d\n# ---- >8 ----\ngenerated with copilot", "e\nf\nWritten with ChatGPT, co-written by codex", "we utilise gpt", "g\nplease Utilise it\nutilised"]
NOTES = [
    (0, "commit/attribution", 3, "AI/tool attribution: Co-Authored-By: GPT"), (4, "commit/attribution", 3, "AI/tool attribution: Written with ChatGPT"), (5, "glossary", 1, 'Avoid word "utilise"'), (6, "glossary", 2, 'Avoid word "Utilise"'),
]


@BOOK.query(f"WITH {mixed_sql(k=len(MESSAGES))} " + " UNION ALL ".join(f"SELECT id AS doc, '{rule}' AS rule, {line} AS line, '{msg}' AS msg FROM c WHERE k = {k}" for k, rule, line, msg in NOTES))
def commit_notes(spark, d):
    return X.commit_notes(mixed(spark, d, k=len(MESSAGES)).select(F.col("id").alias("doc"), pick(MESSAGES, "k").alias("text")), ["utilise"])


# Whole files and whole changes


@BOOK.query("SELECT doc_id AS file, 1 AS at, md5('@@ new file @@' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+')) AS digest FROM documents")
def whole_hunks(spark, d):
    return D.whole_hunks(S.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")).select("file", "at", F.md5(F.col("text").cast("binary")).alias("digest"))


@BOOK.query("WITH f AS (SELECT o_custkey AS doc, o_orderkey AS n, '+++ b/o' || o_orderkey || chr(10) || string_agg(CAST(l_linenumber AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey) SELECT doc, md5(string_agg(t, chr(10) ORDER BY n)) AS digest FROM f GROUP BY doc")
def change_texts(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"), S.order_file().alias("file"))
    hunks = S.table(spark, d, "lineitem").join(o, "l_orderkey").select("doc", "file", F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_linenumber").cast("string").alias("text"))
    out = D.change_text(hunks, o.select("doc", "file", F.col("l_orderkey").alias("n")))
    return out.select("doc", F.md5(F.col("text").cast("binary")).alias("digest"))


@BOOK.query("SELECT 'u' || user_id AS file, COUNT(*) AS commits FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 1 MONTH GROUP BY 1")
def recent_commits(spark, d):
    log = S.table(spark, d, "events").select(text("u", F.col("user_id")).alias("file"), F.col("ts").alias("at"))
    return D.recent_commits(log, log.agg(F.max("at")).first()[0], 1)


@BOOK.query("SELECT 'base' AS scope, COUNT(*) AS n FROM events WHERE event_id % 5 < 3 UNION ALL SELECT 'staged', COUNT(*) FROM events WHERE event_id % 5 = 3 UNION ALL SELECT 'since', COUNT(*) FROM events WHERE event_id % 5 = 4 UNION ALL SELECT 'all', COUNT(*) FROM events")
def changes_by_scope(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("line"))
    sources = {name: e.where(f"line % 5 = {i}") for i, name in enumerate(("committed", "working", "untracked", "index", "range"))} | {"files": e}
    out = None
    for scope in ("base", "staged", "since", "all"):
        row = K.changes_of(scope, sources).agg(F.count("*").alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# Sinks: what was written, read again


def place(spark) -> str:
    ordering.ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sinks-{uuid.uuid4().hex}"


@BOOK.query("WITH f AS (SELECT event_type AS name, event_id AS ord, 'r' AS rule, 'u' || user_id AS file, event_id % 9 AS line, 'm' AS msg FROM events) SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY name ORDER BY ord) <= 200")
def written_report(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("ord"), F.lit("r").alias("rule"), text("u", F.col("user_id")).alias("file"), (F.col("event_id") % 9).alias("line"), F.lit("m").alias("msg"))
    path = place(spark)
    K.write_report(e, path)
    return spark.read.schema(e.schema).json(path)


@BOOK.query("WITH f AS (SELECT event_type AS name, event_id AS ord, 'r  u' || user_id || ':' || event_id % 9 || '  m' AS line FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) <= 15), k AS (SELECT * FROM f ORDER BY name, ord LIMIT 40), s AS (SELECT name, chr(10) || '## ' || name || chr(10) || string_agg('- ' || line, chr(10) ORDER BY ord) AS t FROM k GROUP BY name) SELECT '# Report' || string_agg(t, '' ORDER BY name) || chr(10) AS text FROM s")
def report_markdown(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("ord"), F.lit("r").alias("rule"), text("u", F.col("user_id")).alias("file"), (F.col("event_id") % 9).alias("line"), F.lit("m").alias("msg"))
    return spark.createDataFrame([(K.markdown(e, "Report"),)], "text string")


@BOOK.query(f"WITH {S.SCORED_SQL} SELECT 'functions' AS part, COUNT(*)::DOUBLE AS value FROM scored UNION ALL SELECT 'mean', AVG(risk) FROM risky UNION ALL SELECT 'dead', COUNT(*) FROM nation")
def written_baseline(spark, d):
    scored = C.score(S.functions(spark, d), S.hits(spark, d)).withColumns({"key": F.col("ord").cast("string"), "line": F.col("start")})
    path = place(spark)
    K.write_baseline(scored.where("cc = 1"), S.table(spark, d, "region"), path, red=False, used=True)
    K.write_baseline(scored, S.table(spark, d, "nation"), path, red=False, used=True)
    held = K.read_baseline(spark, path)
    count = lambda part: held[part].agg(F.count("*").cast("double").alias("value")).select(F.lit(part).alias("part"), "value")
    return count("functions").unionByName(count("dead")).unionByName(held["mean"].select(F.lit("mean").alias("part"), F.col("mean_crap").alias("value")))


@BOOK.query("SELECT event_type AS question, event_id % 101 AS p, COUNT(*) AS n FROM events GROUP BY ALL")
def appended_log(spark, d):
    rows = S.table(spark, d, "events").select(F.col("event_type").alias("question"), (F.col("event_id") % 101).alias("p"), "event_id")
    path = place(spark)
    for part in (0, 1, 1, 2, 0):  # a batch that is sent again counts once
        K.append_log(rows.where(f"event_id % 3 = {part}").select("question", "p"), path, f"{part}")
    return spark.read.schema("question string, p long").json(path).groupBy("question", "p").agg(F.count("*").alias("n"))


@BOOK.query("SELECT 'npm:n' || p_partkey || '@1' AS key, CASE WHEN p_size % 3 = 0 THEN 'old' ELSE 'new' END AS published FROM part WHERE p_size % 3 < 2")
def written_cache(spark, d):
    p = S.table(spark, d, "part")
    name = text("n", F.col("p_partkey"))
    cached = p.where("p_size % 3 = 0").select(text("npm:", name, "@1").alias("key"), F.lit("old").alias("published"))
    states = p.where("p_size % 3 > 0").select(F.lit("npm").alias("registry"), name.alias("name"), F.lit("1").alias("version"), F.when(F.col("p_size") % 3 == 1, "old").otherwise("missing").alias("state"), F.when(F.col("p_size") % 3 == 1, "new").alias("published"))
    path = place(spark)
    Y.write_cache(cached, states, path)
    return spark.read.schema("key string, published string").json(path)


@BOOK.query("SELECT 'hooks' AS section, '{\"flag\": false, \"max\": 9}' AS settings UNION ALL SELECT 'thresholds', '{\"max_cc\": 10}'")
def settings_rows(spark, d):
    known = {"thresholds": {"max_cc": 10}, "hooks": {"flag": True, "max": 9}}
    return K.config_row(spark, K.load_config("[hooks]\nflag = false\n", known))


@BOOK.query(f"WITH {S.SCORED_SQL} SELECT ord FROM scored WHERE cc > 12")
def functions_over_set_bar(spark, d):
    held = K.load_config("[thresholds]\nmax_cc = 12\n", {"thresholds": {"max_cc": 10, "max_crap": 1e9}})["thresholds"]
    return C.over_bar(C.score(S.functions(spark, d), S.hits(spark, d)), True, held["max_cc"], held["max_crap"]).select("ord")


@BOOK.query(
    """WITH w AS (SELECT event_id AS ord, event_type || ' u' || user_id AS line FROM events WHERE event_id % 3 = 0), k AS (SELECT 0 AS part, 0 AS o, -1::BIGINT AS ord, '## Gate' AS line UNION ALL (SELECT 0, 1, ord, '- ' || line FROM w ORDER BY ord LIMIT 30)
    UNION ALL SELECT 1, 0, -1, '## Bypasses' UNION ALL SELECT 1, 1, 0, 'none' UNION ALL SELECT 2, 0, -1, '## Escalate to reviewer' UNION ALL (SELECT 2, 1, p_partkey, '- ' || p_name FROM part ORDER BY p_partkey LIMIT 30)) SELECT part, ROW_NUMBER() OVER (PARTITION BY part ORDER BY o, ord) AS n, line FROM k"""
)
def report_texts(spark, d):
    w = S.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("ord"), text(F.col("event_type"), " u", F.col("user_id")).alias("line"))
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("line"))
    return K.report_lines({"Gate": w, "Bypasses": w.limit(0), "Escalate to reviewer": p}, 30).withColumn("n", F.col("n").cast("long"))


# Credentials are put together from parts, so that no line of this file looks like one.
TOKENS = [
    "AKIA" + "Q7" * 8, "-----BEGIN EC " + "PRIVATE KEY-----", "sk-" + "proj-a1" + "b" * 24, "gh" + "s_" + "Z9" * 18, "xox" + "p-" + "1" * 12, "AIza" + "-" * 34 + "x", "123456789:AA" + "c" * 33,
    "/home/zoe/w/x", "/Users/runner/x", "sk-" + "b" * 30, "no secret",
]
PLACES = ["a/b.ts", "uv.lock", ".scratch/x.md", "c/.env.prod", "c/.env.example"]
SECRET_SIZES = {"k": len(TOKENS), "m": 3, "f": len(PLACES)}


@BOOK.query(
    f"""WITH {mixed_sql(**SECRET_SIZES)} SELECT CASE WHEN k < 7 THEN 'secret/token' ELSE 'secret/machine-path' END AS rule, 'd' || id || '/' || {pick_sql(PLACES, 'f')} AS file, id AS line, {pick_sql([None, 'a fixture', 'a sample'], 'm')} AS allowed FROM c WHERE k < 8 AND f <> 1
    UNION ALL SELECT 'secret/env-file', 'd' || id || '/c/.env.prod', 1, NULL FROM c WHERE f = 3"""
)
def secret_lines(spark, d):
    rows = mixed(spark, d, **SECRET_SIZES)
    said = F.concat(F.lit("x = "), pick(TOKENS, "k"), pick(["", " qg:allow a fixture", " gitleaks:allow a sample"], "m"))
    found = X.secret_findings(rows.select(text("d", F.col("id"), "/", pick(PLACES, "f")).alias("file"), F.col("id").alias("line"), said.alias("text")))
    return found.select("rule", "file", F.col("line").cast("long").alias("line"), "allowed")


SPANS = ["src/a.ts", "src/gone.ts", "src/a.ts:9", "src/a.ts:11", "src/a.ts:2-12", "lib/", "./near.md", "mcp.json", "@a/b", "keptName", "lostName", "x.gone()", "kept()", "plain word"]
SPAN_RULES = [None, "doc/path", None, "doc/line", "doc/line", None, None, None, None, None, "doc/symbol", "doc/symbol", None, None]
SPAN_SIZES = {"a": len(SPANS), "b": len(SPANS)}


@BOOK.query(f"WITH {mixed_sql(**SPAN_SIZES)}, r AS (SELECT id, a AS k FROM c UNION SELECT id, b FROM c) SELECT {pick_sql(SPAN_RULES, 'k')} AS rule, id AS line, {pick_sql(SPANS, 'k')} AS token FROM r WHERE {pick_sql(SPAN_RULES, 'k')} IS NOT NULL")
def document_spans(spark, d):
    rows = mixed(spark, d, **SPAN_SIZES)
    lines = rows.select(F.lit("docs/x.md").alias("file"), F.col("id").alias("line"), text("see `", pick(SPANS, "a"), "` and ` ", pick(SPANS, "b"), " `.").alias("text"))
    roots = spark.createDataFrame([("src",), ("lib",), ("docs",)], "name string")
    files = spark.createDataFrame([("src/a.ts", 10), ("docs/near.md", 2), ("lib/b.ts", 1)], "file string, n_lines bigint")
    names = spark.createDataFrame([("keptName",), ("kept",)], "name string")
    return X.doc_findings(X.references(lines, roots), files, names).select("rule", "line", "token").distinct()
