"""Queries over changes that weaken tests or hide findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import patterns as P
from gristmill.operators import review as V
from gristmill.operators import tamper as T
from gristmill.plans import standins as S
from gristmill.plans.cases import Book, mixed, mixed_sql, pick, pick_sql, quoted

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def side_rows(rows, before, after, *more):
    """A hunk for each row: lines ``before`` removed and ``after`` added, nulls left out."""
    both = F.array(*(F.struct(F.lit("-").alias("side"), F.lit(i + 1).alias("line"), c.alias("text")) for i, c in enumerate(before)), *(F.struct(F.lit("+").alias("side"), F.lit(i + 1).alias("line"), c.alias("text")) for i, c in enumerate(after)))
    out = rows.select("file", F.col("id").alias("hunk_ord"), F.col("id").cast("int").alias("new_start"), F.explode(both).alias("x"), *more)
    return out.select("file", "hunk_ord", "new_start", "x.*", *(c for c in out.columns if c not in ("file", "hunk_ord", "new_start", "x"))).where("text is not null")


# Shell commands: what runs before git, options of git, its command, options of that, and what may skip hooks.
SHELL = {
    "runs": ["", "FOO=1 ", "sudo -u me ", "echo ok && ", 'echo "a; b" | ', "x "],
    "opt": ["", "-C /x ", "-c user.name=y ", "-c core.hooksPath=/z ", "--git-dir .git "],
    "verb": ["commit", "push", "log", "config"],
    "arg": ["", "-m 'a; b' ", "-m -n ", "--message=-n ", "-F -n ", "-- ", "-am z ", '"" '],
    "skip": ["", "--no-verify", "-n", "-nm w", "-can", "core.hooksPath /e"],
}
SHELL_SIZES = {k: len(v) for k, v in SHELL.items()}


@BOOK.query(
    f"""WITH {mixed_sql(**SHELL_SIZES)}, r AS (SELECT id AS ord, CASE WHEN runs = 5 THEN NULL WHEN opt = 3 THEN 'git -c core.hooksPath changes the configured hooks'
    WHEN verb = 3 AND skip = 5 THEN 'git config core.hooksPath changes the configured hooks'
    WHEN arg <> 5 AND verb = 0 AND skip IN (1, 2, 3) THEN 'git commit ' || list_value('--no-verify', '-n', '-nm')[skip] || ' skips verification hooks'
    WHEN arg <> 5 AND verb = 1 AND skip = 1 THEN 'git push --no-verify skips verification hooks' END AS reason FROM c) SELECT * FROM r WHERE reason IS NOT NULL"""
)
def hook_bypasses(spark, d):
    rows = mixed(spark, d, **SHELL_SIZES)
    text = F.concat(pick(SHELL["runs"], "runs"), F.lit("git "), pick(SHELL["opt"], "opt"), pick(SHELL["verb"], "verb"), F.lit(" "), pick(SHELL["arg"], "arg"), pick(SHELL["skip"], "skip"))
    return V.hook_bypasses(rows.select(F.col("id").alias("ord"), text.alias("text")))


# Comments: a file's ending, how a comment opens, and what it says.
ENDINGS = ["ts", "py", "go", "rb", "java"]
OPENERS = [("// ", "", 1), ("/* ", " */", 1), ("# ", "", 1), ("/*\n * ", "\n */", 2), ("x = '// ", "'", 0), ('y = "a" // ', "", 1)]
DIRECTIVES = [
    ("eslint-disable", "ts", "eslint-disable suppresses all ESLint rules of the gate"), ("eslint-disable-next-line no-console, max-depth", "ts", "eslint-disable suppresses the gate rule max-depth"),
    ("eslint-disable no-console", "ts", None), ("eslint-disable-line complexity -- old", "ts", "eslint-disable suppresses the gate rule complexity"),
    ("ast-grep-ignore", None, "ast-grep-ignore suppresses the structural rules of the gate"), ("ast-grep-ignore: other, empty-catch", None, "ast-grep-ignore suppresses the gate rule empty-catch"),
    ("ast-grep-ignore: other", None, None), ("noqa: E501", "py", "Python suppression comment hides Ruff form diagnostics"), ("ruff: noqa", "py", "Python suppression comment hides Ruff form diagnostics"),
    ("gocyclo:ignore", "go", "gocyclo:ignore hides Go form diagnostics"), ("nolint", "go", "nolint suppresses Go lint diagnostics"),
    ("nolint:errcheck,gocyclo", "go", "nolint:gocyclo suppresses Go complexity diagnostics"), ("nolint:errcheck", "go", None), ("see eslint-disable", "ts", None),
]
COMMENT_SIZES = {"e": len(ENDINGS), "o": len(OPENERS), "k": len(DIRECTIVES), "touched": 3}


@BOOK.query(
    f"""WITH {mixed_sql(**COMMENT_SIZES)}, r AS (SELECT 'd' || id || '/a.' || {pick_sql(ENDINGS, 'e')} AS file, {pick_sql([o[2] for o in OPENERS], 'o')} AS line,
    CASE WHEN {pick_sql([x[1] or 'any' for x in DIRECTIVES], 'k')} IN ('any', {pick_sql(ENDINGS, 'e')}) AND o <> 4 AND (o <> 2 OR e IN (1, 3)) THEN {pick_sql([x[2] for x in DIRECTIVES], 'k')} END AS msg, touched FROM c)
    SELECT file, line, msg FROM r WHERE msg IS NOT NULL AND touched > 0"""
)
def inline_suppressions(spark, d):
    rows = mixed(spark, d, **COMMENT_SIZES)
    text = F.concat(pick([o[0] for o in OPENERS], "o"), pick([x[0] for x in DIRECTIVES], "k"), pick([o[1] for o in OPENERS], "o"), F.lit("\ncode\n"))
    files = rows.select(F.concat(F.lit("d"), "id", F.lit("/a."), pick(ENDINGS, "e")).alias("file"), text.alias("text"), "touched")
    return T.inline_suppressions(files, files.where("touched > 0").select("file", F.explode(F.array(F.lit(1), F.lit(2))).alias("line")))


# Test headers: two removed and two added ones of these. What stands for a header without its mark is the second value.
HEADERS = [
    ("const x = 1", None), ("test('adds two numbers', f)", "test('adds two numbers', f)"), ("it.skip('reads options', f)", "it('reads options', f)"), ("it('reads many option', f)", "it('reads many option', f)"),
    ("describe('configuration', f)", "describe('configuration', f)"), ("describe('its configuration', f)", "describe('its configuration', f)"), ("test('numbers', f)", "test('numbers', f)"), ("  xit('reads  options', f)", "it('reads options', f)"),
]
HEADER_SIZES = dict.fromkeys(("r1", "r2", "a1", "a2"), len(HEADERS))


def _fits(r: str, a: str) -> str:
    return f"COALESCE(split_part({r}, '(', 1) = split_part({a}, '(', 1) AND (len(list_filter({a}w, lambda w: list_contains({r}w, w))) >= 2 OR len(list_filter({a}w, lambda w: list_contains({r}w, w) AND length(w) >= 7)) > 0), FALSE)"


WORDS_SQL = ", ".join(f"list_transform(list_filter(regexp_extract_all(lower(regexp_extract({x}, '\\(''([^'']+)''', 1)), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), lambda w: regexp_replace(w, '^([a-z]+)s$', '\\1')) AS {x}w" for x in HEADER_SIZES)


@BOOK.query(
    f"""WITH {mixed_sql(**HEADER_SIZES)}, h AS (SELECT id, {', '.join(f'{pick_sql([x[1] for x in HEADERS], k)} AS {k}' for k in HEADER_SIZES)} FROM c), w AS (SELECT *, {WORDS_SQL} FROM h),
    x2 AS (SELECT *, CASE WHEN r2 = a1 THEN 1 WHEN r2 = a2 THEN 2 END AS e2 FROM w),
    x1 AS (SELECT *, CASE WHEN r1 = a1 AND e2 IS DISTINCT FROM 1 THEN 1 WHEN r1 = a2 AND e2 IS DISTINCT FROM 2 THEN 2 END AS e1 FROM x2),
    y2 AS (SELECT *, CASE WHEN e2 IS NOT NULL THEN NULL WHEN {_fits('r2', 'a1')} AND e1 IS DISTINCT FROM 1 THEN 1 WHEN {_fits('r2', 'a2')} AND e1 IS DISTINCT FROM 2 THEN 2 END AS f2 FROM x1),
    y1 AS (SELECT *, CASE WHEN e1 IS NOT NULL THEN NULL WHEN {_fits('r1', 'a1')} AND e2 IS DISTINCT FROM 1 AND f2 IS DISTINCT FROM 1 THEN 1 WHEN {_fits('r1', 'a2')} AND e2 IS DISTINCT FROM 2 AND f2 IS DISTINCT FROM 2 THEN 2 END AS f1 FROM y2)
    SELECT id AS hunk_ord, id AS at FROM y1 WHERE (r2 IS NOT NULL AND e2 IS NULL AND f2 IS NULL) OR (r1 IS NOT NULL AND e1 IS NULL AND f1 IS NULL)"""
)
def deleted_tests(spark, d):
    rows = mixed(spark, d, **HEADER_SIZES).withColumn("file", F.concat(F.lit("d"), F.col("id") % 50, F.lit("/a.test.ts")))
    text = [x[0] for x in HEADERS]
    return T.deleted_tests(side_rows(rows, [pick(text, "r1"), pick(text, "r2")], [pick(text, "a1"), pick(text, "a2")])).select("hunk_ord", F.col("at").cast("long").alias("at"))


@BOOK.query("SELECT DISTINCT user_id || '/a.test.ts' AS file, 1 AS at FROM events WHERE user_id % 3 = 0")
def deleted_test_files(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.col("user_id"), F.lit("/a.test.ts")).alias("file"), (F.col("user_id") % 3 == 0).alias("deleted"))
    return T.deleted_tests(side_rows(e, [F.lit("it('is gone', f)")], [F.when(~F.col("deleted"), F.lit("it('is gone', f)"))], "deleted")).select("file", "at")


# Assertions: what a hunk removes and adds, and whether its file reads source text that the removed one is about.
REMOVED = ["x = 1", "expect(SRC).toContain(1)", "assert.equal(a, 1)", "expect(f(b, g(1))).toBe(2)", "expect(SRC, (1)).toBe(1)"]
ADDED = ["y = 2", "assert.ok(a)", "expect( f(b,g(1)) ).toBeDefined()", "expect(c).toBe(3)", "assert.ok(other)"]
ASSERT_SIZES = {"r": len(REMOVED), "a": len(ADDED), "h": 2, "gone": 3}


@BOOK.query(
    f"""WITH {mixed_sql(**ASSERT_SIZES)}, t AS (SELECT SUM(CASE WHEN a > 0 THEN 1 ELSE 0 END - CASE WHEN r > 0 THEN 1 ELSE 0 END) AS balance FROM c),
    f AS (SELECT id AS at, r > 0 AND a = 0 AND NOT (balance >= 0 AND h = 1 AND r IN (1, 4)) AS fewer, (r = 2 AND a = 1) OR (r = 3 AND a = 2) AS weaker FROM c, t WHERE gone > 0)
    SELECT f.at AS at, concat_ws('; ', CASE WHEN fewer THEN 'fewer assertions in hunk' END, CASE WHEN weaker THEN 'strong assertion replaced with a weak assertion' END) AS msg FROM f WHERE fewer OR weaker"""
)
def assertion_findings(spark, d):
    rows = mixed(spark, d, **ASSERT_SIZES).withColumn("file", F.concat(F.lit("f"), "id", F.lit(".test.ts"))).withColumn("deleted", F.col("gone") == 0)
    harness = F.when(F.col("h") == 1, F.lit('const SRC = readFileSync("src/a.ts")'))
    found = T.assertion_findings(side_rows(rows, [harness, pick(REMOVED, "r")], [pick(ADDED, "a")], "deleted"))
    return found.select(F.col("at").cast("long").alias("at"), "msg")


@BOOK.query(f"WITH {mixed_sql(**ASSERT_SIZES)}, t AS (SELECT SUM(CASE WHEN a > 0 THEN 1 ELSE 0 END - CASE WHEN r > 0 THEN 1 ELSE 0 END) AS balance FROM c) SELECT id AS hunk_ord FROM c, t WHERE balance >= 0 AND h = 1 AND r IN (1, 4) AND a = 0")
def harness_removals(spark, d):
    rows = mixed(spark, d, **ASSERT_SIZES).withColumn("file", F.concat(F.lit("f"), "id", F.lit(".test.ts")))
    harness = F.when(F.col("h") == 1, F.lit('const SRC = readFileSync("src/a.ts")'))
    return T.harness_removals(side_rows(rows, [harness, pick(REMOVED, "r")], [pick(ADDED, "a")])).select("hunk_ord")


# Mocks: the call and the module. The fourth value says in which language's tests the module is one that changed.
CALLS = [("vi.mock('", "ts"), ("jest.mock(`", "ts"), ('mock.module("', "ts"), ("@patch('", "py"), ('mocker.patch("', "py"), ("monkeypatch.setattr('", "py"), ("monkeypatch.delenv('", "py")]
MODULES = [("./a", "ts"), ("../b", "ts"), ("../../lib/c.js", "ts"), ("src/deep/a.ts", "ts"), ("pkg.mod.f", "py"), ("pkg.mod", "py"), ("pkg.model", ""), ("pkg", ""), ("./gone", ""), ("src/b", "ts")]
MOCK_SIZES = {"m": len(CALLS), "k": len(MODULES)}
CHANGED = ["src/deep/a.ts", "src/b/index.tsx", "lib/c.jsx", "pkg/mod/__init__.py"]


@BOOK.query(
    f"""WITH {mixed_sql(**MOCK_SIZES)}, r AS (SELECT id AS line, CASE WHEN m < 6 THEN {pick_sql([x[0] for x in MODULES], 'k')} END AS target, m < 6 AND {pick_sql([x[1] for x in CALLS], 'm')} = {pick_sql([x[1] for x in MODULES], 'k')} AS changed FROM c)
    SELECT line, target FROM r WHERE NOT changed"""
)
def unneeded_mocks(spark, d):
    rows = mixed(spark, d, **MOCK_SIZES)
    quote = F.substr(pick([x[0] for x in CALLS], "m"), F.length(pick([x[0] for x in CALLS], "m")))
    text = F.concat(F.lit("  "), pick([x[0] for x in CALLS], "m"), pick([x[0] for x in MODULES], "k"), quote, F.lit(", f)"))
    file = F.when(F.col("m") < 3, F.concat(F.lit("src/deep/t"), "id", F.lit(".test.ts"))).otherwise(F.concat(F.lit("tests/test_t"), "id", F.lit(".py")))
    sources = spark.createDataFrame([(x,) for x in CHANGED], "file string")
    return T.mocks_of_unchanged(rows.select(file.alias("file"), F.lit("+").alias("side"), F.col("id").alias("line"), text.alias("text")), sources).select("line", "target")


@BOOK.query(
    f"""WITH {mixed_sql(k=4)} SELECT 'note: tamper/mock-added t' || id || '.test.ts:+' || id || ' ' || CASE k WHEN 0 THEN './gone' WHEN 1 THEN 'local stub shadows load from src/load.ts' ELSE 'local stub shadows saveAll from src/save.ts' END AS note FROM c WHERE k < 3"""
)
def mock_notes(spark, d):
    rows = mixed(spark, d, k=4)
    text = pick(["vi.mock('./gone')", "const load = () => 1", "  async function fakeSaveAll(x) {", "load()"], "k")
    names = spark.createDataFrame([(None, "load", 1, 0, "src/load.ts"), (None, "saveAll", 1, 1, "src/save.ts")], "file string, name string, rank int, ord int, source string")
    changed = rows.select(F.concat(F.lit("t"), "id", F.lit(".test.ts")).alias("file"), F.lit("+").alias("side"), F.col("id").alias("line"), text.alias("text"))
    return T.mock_notes(changed, spark.createDataFrame([("src/load.ts",)], "file string"), names)


# Allow markers: the line, and how many lines of its file change.
MARKS = [("// qg:allow because", True, True), ("<!-- gitleaks:allow a key -->", True, True), ("x = 1 # qg:allow it", True, False), ("see `qg:allow why`", False, False), ("plain", False, False), ("  qg:test-removed moved", True, True)]
MARK_SIZES = {"k": len(MARKS), "more": 3, "place": 2}


@BOOK.query(
    f"""WITH {mixed_sql(**MARK_SIZES)} SELECT id AS line, more > 0 OR NOT {pick_sql([x[2] for x in MARKS], 'k')} AS other FROM c WHERE {pick_sql([x[1] for x in MARKS], 'k')} AND place = 0"""
)
def allow_markers(spark, d):
    rows = mixed(spark, d, **MARK_SIZES)
    file = F.concat(pick(["a", ".scratch/a"], "place"), F.col("id"))
    lines = F.concat(F.array(pick([x[0] for x in MARKS], "k")), F.array_repeat(F.lit("more"), F.col("more")))
    changed = rows.select(file.alias("file"), F.lit("+").alias("side"), F.col("id").alias("line"), F.explode(lines).alias("text"))
    return T.marker_changes(changed).select("line", "other")


CONFIG = [("thresholds", "max_cc"), ("project", "src"), ("project", "base"), ("hooks", "pre_push_timeout"), ("hooks", "flag"), ("review", "anything"), ("tools", "knip")]


@BOOK.query(
    f"""WITH {mixed_sql(s=len(CONFIG), old=3, new=3)}, k AS (SELECT DISTINCT s, old, new FROM c WHERE s IN (0, 1, 3, 5) AND old <> new), v AS (SELECT CASE s WHEN 1 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS o,
    {pick_sql([f'{a}.{b}' for a, b in CONFIG], 's')} || old || new || ' ' || CASE old WHEN 0 THEN '<unset>' ELSE '"v' || old || '"' END || ' -> ' || CASE new WHEN 0 THEN '<unset>' ELSE '"v' || new || '"' END AS t, {pick_sql([b for _, b in CONFIG], 's')} || old || new AS n FROM k)
    SELECT '.scratch/quality/baseline.json' AS file, 1 AS line, 'quality baseline changed' AS msg, TRUE AS blocks UNION ALL SELECT '.quality.toml', 7, 'protected config changed: ' || string_agg(t, '; ' ORDER BY o, n), TRUE FROM v"""
)
def protected_changes(spark, d):
    # Settings of the same section whose names are told apart by their values; all of a protected section count.
    rows = mixed(spark, d, s=len(CONFIG), old=3, new=3).select("s", "old", "new").distinct()
    value = lambda c: F.when(F.col(c) > 0, F.concat(F.lit('"v'), F.col(c), F.lit('"')))
    name = F.concat(pick([b for _, b in CONFIG], "s"), F.col("old"), F.col("new"))
    protected = {k: [f"{n}{i}{j}" for n in v for i in range(3) for j in range(3)] for k, v in P.PROTECTED_KEYS.items()}
    config = rows.select(pick([a for a, _ in CONFIG], "s").alias("section"), name.alias("name"), value("old").alias("old"), value("new").alias("new"))
    changed = spark.createDataFrame([(".scratch/quality/baseline.json", 1, 3, "+", 3, "x"), (".quality.toml", 1, 7, "+", 7, "y"), ("src/a.ts", 1, 1, "+", 1, "z")], "file string, hunk_ord int, new_start int, side string, line int, text string")
    return T.protected_changes(changed, config, ["src"], keys=protected)


@BOOK.query(
    f"""WITH {mixed_sql(m=3, a=3, p=2)} SELECT id, CASE WHEN m = 0 THEN 'commit-msg' WHEN a = 0 AND p = 1 THEN 'allow.md' END AS source, CASE WHEN m = 0 THEN 'said so' WHEN a = 0 AND p = 1 THEN 'written down' END AS reason FROM c"""
)
def removal_reasons(spark, d):
    rows = mixed(spark, d, m=3, a=3, p=2)
    messages, allowed = pick(["fix\n\nqg:test-removed said so \nx", "fix", "xqg:test-removed no"], "m"), pick(["# notes\nqg:test-removed written down", "", "qg:test-removed"], "a")
    return rows.select("id", T.removal_reason(messages, allowed, F.col("p") == 1).alias("r")).select("id", "r.source", "r.reason")


@BOOK.query("SELECT event_id AS line, 'tamper/test-skipped' AS rule FROM events WHERE event_id % 2 = 1")
def accepted_deletions(spark, d):
    rule = F.when(F.col("event_id") % 2 == 0, "tamper/test-deleted").otherwise("tamper/test-skipped")
    return T.bypassed_deletions(S.table(spark, d, "events").select(F.col("event_id").alias("line"), rule.alias("rule")), "moved")


# Files in projects: a root for each language, and a test's name that counts from it.
PLACES = [("a/src/test/X.java", "a", "java", True), ("a/src/test/X.java", "a/src", "java", False), ("b/tests/x.rs", ".", "rust", True), ("b/x_test.go", "b", "go", True), ("c/x.test.ts", "c", "ts", True), ("c/x.ts", "c", "ts", False), ("none/x.test.ts", None, "ts", False)]


@BOOK.query(f"WITH {mixed_sql(k=len(PLACES))} SELECT id || '/' || {pick_sql([p[0] for p in PLACES], 'k')} AS file, {pick_sql([p[3] for p in PLACES], 'k')} AS is_test FROM c")
def tests_below_roots(spark, d):
    rows = mixed(spark, d, k=len(PLACES)).withColumn("file", F.concat("id", F.lit("/"), pick([p[0] for p in PLACES], "k")))
    root = pick([p[1] for p in PLACES], "k")
    roots = rows.where(root.isNotNull()).select("file", F.when(root == ".", F.col("id").cast("string")).otherwise(F.concat("id", F.lit("/"), root)).alias("root"))
    return T.test_files(rows.select("file"), roots).select("file", "is_test")


__all__ = ["ORACLES", "QUERIES", "quoted"]
