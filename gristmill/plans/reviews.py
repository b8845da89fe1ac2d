"""Queries over lines of text, test changes, review questions and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import patterns
from gristmill.operators import report as K
from gristmill.operators import review as V
from gristmill.operators import tamper as T
from gristmill.operators import text as X
from gristmill.plans import standins as S
from gristmill.plans.formats import cat, key
from gristmill.plans.modules import place
from gristmill.streaming import sessions as N

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def chosen(spark, d, texts, *more):
    """id, i and the i-th of ``texts``, by the event's number."""
    i = (F.col("event_id") % len(texts)).cast("int")
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), i.alias("i"), F.get(F.array(*map(F.lit, texts)), i).alias("text"), *more)


def where_sql(n: int, hits: list[int], columns: str = "event_id AS id") -> str:
    return f"SELECT {columns} FROM events WHERE event_id % {n} IN ({', '.join(map(str, hits))})"


# Credentials are put together here, so that no line of this file looks like one.
SECRET_TEXTS = [
    "key AKIA" + "ABCDEFGH12345678", "-----BEGIN RSA " + "PRIVATE KEY-----", "sk-" + "ant-abc1defghijklmnopqrstuvwx", "sk-" + "abcdefghijklmnopqrstuvwxyz", "gh" + "p_" + "a1" * 18, "xox" + "b-1234567890-ab",
    "AIza" + "a" * 35, "12345678:AA" + "b" * 33, "see /home/carol/x.txt", "see /home/user/x.txt", "/Users/dave/a qg:allow a fixture", "plain words", "token = abcdefgh12", "x/home/erin/y", "AKIA" + "SHORT",
]


@query(f"SELECT event_id AS id, CASE WHEN event_id % 15 IN (8, 10) THEN 'secret/machine-path' ELSE 'secret/token' END AS rule, CASE WHEN event_id % 15 = 10 THEN 'a fixture' END AS allowed FROM events WHERE event_id % 15 IN (0, 1, 2, 4, 5, 6, 7, 8, 10) UNION ALL SELECT 1, 'secret/env-file', NULL FROM events WHERE event_id % 15 = 11 AND event_id % 4 = 3 HAVING COUNT(*) > 0")
def secret_findings(spark, d):
    file = F.when((F.col("event_id") % 15 == 11) & (F.col("event_id") % 4 == 3), "a/.env.local").otherwise("a/b.ts")
    rows = chosen(spark, d, SECRET_TEXTS, file.alias("file"), F.col("event_id").alias("line"))
    return X.secret_findings(rows).select(F.col("line").cast("bigint").alias("id"), "rule", "allowed")


@query(f"WITH {S.DOC_LINE_SQL} SELECT doc_id, line FROM doc_line WHERE regexp_matches(text, 'AKIA[0-9A-Z]{{16}}') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(text, '\\bgh[pousr]_[A-Za-z0-9]{{36,}}') OR regexp_matches(text, '\\bxox[abprs]-[A-Za-z0-9-]{{10,}}') OR regexp_matches(text, '\\bAIza[0-9A-Za-z_-]{{35}}\\b') OR regexp_matches(text, '\\b[0-9]{{8,10}}:AA[A-Za-z0-9_-]{{33}}\\b') OR (regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{{24,}}') AND regexp_matches(regexp_extract(text, '\\bsk-[A-Za-z0-9_-]{{24,}}'), '[0-9]'))")
def document_secret_lines(spark, d):
    return S.document_lines(spark, d).where(X.any_of(F.col("text"), patterns.SECRETS)).select("doc_id", "line")


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[0-9A-Za-z_-]{35}\b|\b[0-9]{8,10}:AA[A-Za-z0-9_-]{33}\b', '[REDACTED]', 'g'), '(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|token|secret|password)\s*([=:])\s*["'']?[^\s"'']{8,}', '\1\2[REDACTED]', 'g'), '/(Users|home)/[A-Za-z][\w.-]*/', '/[REDACTED]/', 'g')) AS digest FROM documents"""
)
def redacted_documents(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text")).cast("binary")).alias("digest"))


@query("WITH r AS (SELECT user_id AS file, event_id AS line, event_id % 5 = 0 AS fence, SUM(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT file, line FROM r WHERE fence OR n % 2 = 0")
def prose_lines(spark, d):
    rows = chosen(spark, d, ["  ```js", "a", "b", "c ```", "~~"], F.col("user_id").alias("file"), F.col("event_id").alias("line"))
    return X.prose_lines(rows).select("file", "line")


@query(f"WITH {S.DOC_LINE_SQL}, m AS (SELECT doc_id, line, regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(thereof|the|von der|ción)(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS w FROM doc_line) SELECT 'glossary' AS rule, doc_id AS file, line, 'Avoid word \"' || w || '\"' AS msg FROM m WHERE w <> ''")
def glossary_findings(spark, d):
    return X.glossary_findings(S.document_lines(spark, d).withColumnRenamed("doc_id", "file"), ["thereof", "the", "von der", "ción"])


PHRASE_SQL = r"""bench AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS t FROM benchmark),
cut AS (SELECT DISTINCT lower(array_to_string(t[i:i + n - 1], '')) AS term, n FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM bench), (VALUES (1), (3), (5)) s(n) WHERE i + n - 1 <= len(t)),
term AS (SELECT term FROM cut WHERE regexp_matches(term, '^(?:[\p{L}\p{N}_]{10,}|[\p{L}\p{N}_]+( [\p{L}\p{N}_]+){1,2})$'))"""


@query(
    f"""WITH {S.DOC_LINE_SQL}, {PHRASE_SQL}, tok AS (SELECT doc_id, line, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]') AS t FROM doc_line),
place AS (SELECT doc_id, line, t, unnest(range(1, len(t) + 1)) AS i FROM tok),
run AS (SELECT doc_id, line, i, array_to_string(t[i:i + n - 1], '') AS said FROM place, (VALUES (1), (3), (5)) s(n) WHERE i + n - 1 <= len(t)),
hit AS (SELECT doc_id, line, said, ROW_NUMBER() OVER (PARTITION BY doc_id, line ORDER BY i, length(said)) AS k FROM run JOIN term ON lower(said) = term.term)
SELECT 'glossary' AS rule, doc_id AS file, line, 'Avoid word "' || said || '"' AS msg FROM hit WHERE k = 1"""
)
def glossary_terms(spark, d):
    """Avoided words from a table: the long words, pairs and triples of words of all benchmark items."""
    text = F.lower("text")
    word = r"[\p{L}\p{N}_]+"
    runs = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?=({p})(?![\p{{L}}\p{{N}}_]))"), F.lit(1)) for p in (r"[\p{L}\p{N}_]{10,}", f"{word} {word}", f"{word} {word} {word}"))))
    terms = S.table(spark, d, "benchmark").select(F.explode(runs).alias("term")).distinct().withColumn("ord", F.length("term"))
    return X.glossary_findings(S.document_lines(spark, d).withColumnRenamed("doc_id", "file"), terms)


@query("SELECT 't' || event_id % 9 AS term FROM events WHERE event_id % 3 = 0 GROUP BY 1 EXCEPT SELECT 't3'")
def avoided_terms(spark, d):
    n = (F.col("event_id") % 9).cast("string")
    text = F.when(F.col("event_id") % 3 == 0, cat("_Avoid_: t", n, ",  t", n)).when(F.col("event_id") % 3 == 1, cat("_Avoid_: x", n, " for money")).otherwise("t1, t2")
    allow = spark.createDataFrame([("T3",)], "term string")
    return X.avoid_terms(S.table(spark, d, "events").select(text.alias("text")), "_Avoid_:", allow)


COMMITS = ["fix: a\n\nCo-Authored-By: GPT <x@y>", "fix: b", "c\n# generated by codex\nrest", "d\n# ---- >8 ----\ngenerated with copilot", "e\nf\nWritten with ChatGPT, co-written by codex", "we discuss gpt"]


@query("SELECT event_id AS doc, 1 AS n_attributions, CASE event_id % 6 WHEN 0 THEN 3 ELSE 3 END AS first_line FROM events WHERE event_id % 6 IN (0, 4)")
def commit_attributions(spark, d):
    return X.commit_findings(chosen(spark, d, COMMITS).withColumnRenamed("id", "doc"))


REFS = ["see `src/a.ts:3` now", "see `src/a.ts:1-99`", "see `src/gone.ts`", "call `readOpts` and `x.lostName()`", "`mcp.json` `@a/b` `plain`", "`./near.md` and `lib/`", "no ticks"]


@query("SELECT CASE event_id % 7 WHEN 1 THEN 'doc/line' WHEN 2 THEN 'doc/path' ELSE 'doc/symbol' END AS rule, event_id AS line, CASE event_id % 7 WHEN 1 THEN 'src/a.ts:1-99' WHEN 2 THEN 'src/gone.ts' ELSE 'x.lostName()' END AS token FROM events WHERE event_id % 7 IN (1, 2, 3)")
def doc_links(spark, d):
    rows = chosen(spark, d, REFS, F.lit("docs/x.md").alias("file"), F.col("event_id").alias("line"))
    roots = spark.createDataFrame([("src",), ("lib",), ("docs",)], "name string")
    files = spark.createDataFrame([("src/a.ts", 10), ("docs/near.md", 2), ("lib/b.ts", 1)], "file string, n_lines bigint")
    names = spark.createDataFrame([("readOpts",)], "name string")
    return X.doc_findings(X.references(rows, roots), files, names).select("rule", "line", "token")


@query("SELECT event_id AS line, 'src/a.ts' AS deleted FROM events WHERE event_id % 7 < 2")
def deleted_references(spark, d):
    rows = chosen(spark, d, REFS, F.lit("docs/x.md").alias("file"), F.col("event_id").alias("line"))
    return X.deleted_references(rows, spark.createDataFrame([("src/a.ts",), ("other",)], "file string")).select("line", "deleted")


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS line FROM events WHERE event_id % 4 < 3")
def match_lines(spark, d):
    rows = chosen(spark, d, ["x = 1\ny", "a\nb\n x=2", "a\nx", "none"])
    return rows.where(F.col("text").rlike("x")).select("id", X.line_of(F.col("text"), "x").cast("int").alias("line"))


# Test changes: a hunk for each event.
TAMPERS = [
    ("a.test.ts", "test('adds numbers', f)", "test.skip('adds numbers', f)"),
    ("a.test.ts", "it('reads options', f)", "it('reads two options', f)"),
    ("a.test.ts", "it('reads options', f)", "expect(1).toBe(1)"),
    ("test_b.py", "    assert total(x) == 3", "    assert total(x)"),
    ("test_b.py", "def test_old():", "def helper():"),
    ("c.go", "x := 1", "t.Skip()"),
    ("c_test.go", "require.Equal(t, 1, x)", "t.Skip()"),
    ("a.spec.js", "expect(a).toBe(1); // x", "describe.only('all', f)"),
]


def hunks(spark, d):
    i = (F.col("event_id") % len(TAMPERS)).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(t[k]) for t in TAMPERS)), i)
    file = F.concat(F.col("user_id"), F.lit("/"), pick(0))
    base = S.table(spark, d, "events").select(F.col("event_id").alias("hunk_ord"), file.alias("file"), F.col("event_id").cast("int").alias("new_start"), F.posexplode(F.array(pick(1), pick(2))).alias("s", "text"))
    return base.select("hunk_ord", "file", "new_start", F.when(F.col("s") == 0, "-").otherwise("+").alias("side"), F.col("new_start").alias("line"), "text")


@query(where_sql(8, [0, 6, 7], "event_id AS line"))
def skipped_tests(spark, d):
    return T.skipped_tests(hunks(spark, d)).select(F.col("line").cast("bigint").alias("line"))


@query(where_sql(8, [6, 7], "event_id AS hunk_ord, 1 AS removed, 0 AS added"))
def fewer_assertions(spark, d):
    return T.assertion_counts(hunks(spark, d)).select("hunk_ord", "removed", "added")


@query(where_sql(8, [3], "event_id AS hunk_ord"))
def bare_asserts(spark, d):
    return T.bare_asserts_weakened(hunks(spark, d)).select("hunk_ord")


@query("SELECT event_id AS doc, CASE event_id % 4 WHEN 0 THEN 'f(a,b)' WHEN 1 THEN 'x' WHEN 2 THEN 'a+b' END AS target FROM events WHERE event_id % 4 < 3")
def call_targets(spark, d):
    rows = chosen(spark, d, ["expect(f(a, b), 2).toBe(1)", "assert.equal( x , y)", "expect((a + b)).toBe(1)", "expect("]).withColumnRenamed("id", "doc")
    return T.call_targets(rows, r"\b(?:assert(?:\.\w+)?|expect)\s*\(")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'moved to b' ELSE 'gone for good' END AS reason FROM events WHERE event_id % 3 < 2")
def marker_reasons(spark, d):
    rows = chosen(spark, d, ["fix\n\nqg:test-removed moved to b \nx", "qg:test-removed gone for good", "xqg:test-removed no"])
    return rows.select("id", T.marker_reason(F.col("text"), "qg:test-removed").alias("reason")).where("reason is not null")


HUNKS = ["try { a() } catch (e) { log.error(e.message) }", "while (x) { attempts++ }", "<Table className='grid-cols-4'>", "const a = 1", "if (rows.length === 0) return <EmptyState/>", "throw new Error('x')"]
ASKED = {0: ["raw_error_shown", "silent_failure", "secrets_in_logs", "error_path_tested"], 1: ["unbounded_turn"], 2: ["mobile_not_handled"], 4: ["empty_state_dead_end"], 5: ["error_path_tested"]}


@query("SELECT event_id AS at, UNNEST(CASE event_id % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in ASKED.items()) + " END) AS question FROM events")
def review_questions(spark, d):
    return V.questions(chosen(spark, d, HUNKS).select(F.lit("a.tsx").alias("file"), F.col("id").alias("at"), "text")).select("at", "question")


@query(where_sql(6, [1, 5], "event_id AS at, CASE event_id % 6 WHEN 1 THEN 'loops' ELSE 'errors' END AS question"))
def project_questions(spark, d):
    rules = spark.createDataFrame([("loops", r"^a\.", "while"), ("errors", r"\.tsx\z", "new Error"), ("never", r"\.py\z", ".")], "question string, glob string, trigger string")
    return V.project_questions(chosen(spark, d, HUNKS).select(F.lit("a.tsx").alias("file"), F.col("id").alias("at"), "text"), rules).select("at", "question")


@query("WITH v AS (SELECT event_id, event_type AS question, (event_id % 101) / 100 AS p FROM events) SELECT event_id AS file, p FROM v WHERE CASE WHEN question = (SELECT MIN(event_type) FROM events) THEN p < 0.2 ELSE p >= 0.75 END")
def noted_verdicts(spark, d):
    e = S.table(spark, d, "events")
    low = e.agg(F.min("event_type")).first()[0]
    kinds = e.select(F.col("event_type").alias("question")).distinct()
    limits = kinds.select("question", F.when(F.col("question") == low, 0.2).otherwise(0.75).alias("limit"), (F.col("question") == low).alias("below"))
    v = e.select(F.col("event_type").alias("question"), F.col("event_id").alias("file"), ((F.col("event_id") % 101) / 100).alias("p"))
    return V.noted(v, limits).select("file", "p")


@query("SELECT event_id AS ord FROM events ORDER BY event_id % 7 = 0 DESC, event_id LIMIT 25")
def first_requests(spark, d):
    return V.first_requests(S.table(spark, d, "events").select(F.col("event_id").alias("ord"), (F.col("event_id") % 7 == 0).alias("has_pack")), 25).select("ord")


@query("WITH x AS (SELECT user_id AS doc, event_id AS ord, repeat('x', CAST(event_id % 40 AS INTEGER)) AS text FROM events), s AS (SELECT *, SUM(length(text) + 3) OVER (PARTITION BY doc ORDER BY ord) AS s FROM x) SELECT doc, ord FROM s WHERE s + 2 <= 200")
def clipped_items(spark, d):
    rows = S.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), F.repeat(F.lit("x"), (F.col("event_id") % 40).cast("int")).alias("text"))
    return V.clipped(rows, 200).select("doc", "ord")


@query("WITH x AS (SELECT user_id AS doc, event_id AS ord, event_id % 40 AS n FROM events), s AS (SELECT *, COALESCE(SUM(n + 3) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x) SELECT doc, ord, LEAST(n, 200 - b)::BIGINT AS chars FROM s WHERE b < 200")
def packed_texts(spark, d):
    rows = S.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), F.repeat(F.lit("x"), (F.col("event_id") % 40).cast("int")).alias("text"))
    return V.packed(rows, 200).select("doc", "ord", F.length("text").cast("long").alias("chars"))


@query("SELECT 'o' || l_orderkey AS file, COUNT(*) FILTER (l_returnflag = 'A') AS added, COUNT(*) FILTER (l_returnflag <> 'A') AS removed FROM lineitem GROUP BY 1")
def change_summaries(spark, d):
    rows = S.table(spark, d, "lineitem").select(S.order_file("l_orderkey").alias("file"), F.when(F.col("l_returnflag") == "A", "+").otherwise("-").alias("side"))
    return V.summaries(rows)


@query("WITH f AS (SELECT c_name AS file, CASE WHEN c_custkey % 3 = 1 THEN 2 WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS bucket FROM customer) SELECT file, bucket, ROW_NUMBER() OVER (ORDER BY bucket, file) AS n FROM f")
def ordered_files(spark, d):
    k = F.col("c_custkey") % 3
    files = S.table(spark, d, "customer").select(F.col("c_name").alias("file"), (k == 1).alias("t"), (k == 0).alias("s"))
    return V.ordered_files(files.select("*"), F.col("t"), F.col("s")).select("file", "bucket", F.col("n").cast("long").alias("n"))


@query("SELECT doc_id, len(list_filter(string_split_regex(trim(text), '[ \\t\\n\\f\\r\\v]+'), lambda w: regexp_matches(w, '^[\\p{L}][\\p{L}''ʻʼ’]*[,.!?:;»\"]*$')))::BIGINT AS words FROM documents")
def prose_words(spark, d):
    return S.table(spark, d, "documents").select("doc_id", V.prose_words(F.col("text")).cast("long").alias("words"))


@query("WITH r AS (SELECT user_id AS file, event_id AS line, 'b' || event_id % 7 AS label, event_id % 2 = 0 AS added FROM events), g AS (SELECT file, label, COUNT(*) AS n, MIN(line) AS line, bool_or(added) AS added FROM r GROUP BY 1, 2) SELECT file, line, label FROM g WHERE n > 1 AND added QUALIFY ROW_NUMBER() OVER (PARTITION BY file ORDER BY line) <= 10")
def duplicate_labels(spark, d):
    text = cat('<Button size="s"> b', (F.col("event_id") % 7).cast("string"), " </Button>")
    rows = S.table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), text.alias("text"), (F.col("event_id") % 2 == 0).alias("added"))
    first = F.least("line", F.get("same", F.lit(0))["line"])
    return V.duplicate_labels(rows).groupBy("file", "label").agg(F.min(first).alias("line")).select("file", "line", "label")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n FROM events")
def occurrences(spark, d):
    return chosen(spark, d, ["aaaa", "xaab", "a.a"]).select("id", V.occurrences(F.col("text"), "aa").alias("n"))


@query("WITH s AS (SELECT user_id AS session, ts, event_id AS ord, event_type AS head, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT session, ord, head FROM s WHERE p <> head")
def moved_sessions(spark, d):
    return N.moved(states(spark, d)).select("session", "ord", "head")


def states(spark, d):
    return S.table(spark, d, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("head"))


@query("WITH s AS (SELECT user_id % 5 AS repo, event_id AS ord, CASE WHEN event_id % 4 > 0 THEN event_type END AS key, LAG(CASE WHEN event_id % 4 > 0 THEN event_type END) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS p FROM events) SELECT repo, ord, key FROM s WHERE p IS DISTINCT FROM key")
def notes_shown(spark, d):
    rows = S.table(spark, d, "events").select((F.col("user_id") % 5).alias("repo"), "ts", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("key"))
    return N.shown_once(rows).select("repo", "ord", "key")


# The same over streams of the table's rows; a row that the watermark has not reached in whole milliseconds waits.
BEFORE_LAST = " AND (epoch_us(ts) + 999) // 1000 <= (SELECT MAX(epoch_us(ts)) // 1000 FROM events)"


def event_stream(spark, d):
    return spark.readStream.schema(S.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query(ORACLES["moved_sessions"] + BEFORE_LAST)
def moved_sessions_stream(spark, d):
    rows = event_stream(spark, d).select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("head"))
    return N.run_stream(N.ordered_moves(rows, "0 seconds"), place(spark)).select("session", "ord", "head")


@query(ORACLES["notes_shown"].replace("event_id AS ord", "event_id AS ord, ts") + BEFORE_LAST)
def notes_shown_stream(spark, d):
    rows = event_stream(spark, d).select((F.col("user_id") % 5).alias("repo"), "ts", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("key"))
    return N.run_stream(N.ordered_notes(rows, "0 seconds"), place(spark)).select("repo", "ord", "key")


@query("WITH s AS (SELECT user_id AS session, MAX_BY(event_type, (ts, event_id)) AS head, MAX((ts, event_id)) AS seen FROM events GROUP BY 1) SELECT session, head FROM s ORDER BY seen DESC, session LIMIT 50")
def recent_sessions(spark, d):
    return N.recent_sessions(states(spark, d))


@query(ORACLES["recent_sessions"])
def recent_sessions_stream(spark, d):
    rows = event_stream(spark, d).select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("head"))
    return N.recent_sessions(N.run_stream(N.recent_stream(rows), place(spark)))


@query("SELECT event_id AS ord, 'not' AS state FROM events WHERE event_id % 3 = 0 AND FALSE UNION ALL SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'findings' WHEN 1 THEN 'clean' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'clean' ELSE 'missing' END ELSE CASE WHEN event_id % 3 = 0 THEN 'clean' ELSE 'failed' END END FROM events")
def tool_results(spark, d):
    e = F.col("event_id")
    rows = S.table(spark, d, "events").select(
        e.alias("ord"), F.when(e % 4 == 1, "audit").otherwise("form").alias("kind"), F.when(e % 4 == 0, 2).otherwise(0).alias("n"),
        F.when(e % 4 == 0, 1).when(e % 4 == 1, 1).when(e % 3 == 0, 0).when(e % 4 == 2, 127).otherwise(2).alias("code"), F.when(e % 4 == 2, "Tool Not Found").otherwise("boom").alias("error"),
    )
    return K.tool_state(rows).select("ord", "state")


@query("SELECT event_id AS ord, event_type || '  u' || user_id || ':' || event_id % 9 || '  m' AS line FROM events")
def finding_lines(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("rule"), cat("u", key("user_id")).alias("file"), (F.col("event_id") % 9).alias("line"), F.lit("m").alias("msg"))
    return e.select("ord", K.finding_line().alias("line"))


@query("SELECT event_id AS ord, 'RED FLAG: ' || CASE WHEN event_id % 3 = 0 THEN 'secret/token' ELSE 'tamper/test-skipped' END || '  f:1  m -- ' || CASE WHEN event_id % 3 = 0 THEN 'a committed secret stays in git history and has to be rotated; check: is it a real credential? move it to the environment or a secret store; rotate it if it was pushed' ELSE 'a green run stops proving the code works; check: is the test change intended? restore it, or say why in the commit message' END AS line FROM events WHERE event_id % 3 < 2")
def red_flag_lines(spark, d):
    rule = F.get(F.array(*map(F.lit, ["secret/token", "tamper/test-skipped", "crap"])), (F.col("event_id") % 3).cast("int"))
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("ord"), rule.alias("rule"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("m").alias("msg"))
    return K.red_flag_lines(rows).select("ord", "line")


@query("SELECT 'c' || event_id AS name, CASE event_id % 4 WHEN 0 THEN 'c' || event_id || ': ERROR e' WHEN 1 THEN 'f1' WHEN 2 THEN 'n1' ELSE 'note' END AS text FROM events")
def check_outputs(spark, d):
    e = F.col("event_id")
    lists = lambda k, v: F.when(e % 4 <= k, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    rows = S.table(spark, d, "events").select(cat("c", key("event_id")).alias("name"), F.when(e % 4 == 0, "e").alias("error"), lists(1, "f1").alias("findings"), lists(2, "n1").alias("notices"), F.lit("note").alias("note"))
    return K.check_output(rows).select("name", F.array_join("output", "|").alias("text"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'a=2;' END AS mutant, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM events")
def mutant_targets(spark, d):
    return K.mutant_target(chosen(spark, d, ["a=1;", "=1 =1", "none"]), "=1", "=2").select("id", "mutant", "n")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'FINDINGS (2)|RED FLAG: x' WHEN 1 THEN '' ELSE 'quality gate crashed: y' END AS text FROM events")
def stop_notes(spark, d):
    return chosen(spark, d, ["FINDINGS (2)\nrow\nRED FLAG: x\n", "CLEAN", "a\nquality gate crashed: y"]).select("id", F.array_join(K.stop_lines(F.col("text")), "|").alias("text"))


@query("SELECT file FROM (SELECT list_value('src/a.ts', 'src/a.test.ts', 'fixtures/b.go', 'x/c.go', 'readme.md', 'node_modules/d.js')[event_id % 6 + 1] AS file FROM events) WHERE file IN ('src/a.ts', 'src/a.test.ts', 'x/c.go') GROUP BY file")
def source_files(spark, d):
    return K.source_files(chosen(spark, d, ["src/a.ts", "src/a.test.ts", "fixtures/b.go", "x/c.go", "readme.md", "node_modules/d.js"]).select(F.col("text").alias("file")).distinct())


@query("SELECT file FROM (SELECT list_value('a/package-lock.json', 'uv.lock', 'x.lock', 'b/Cargo.lock')[event_id % 4 + 1] AS file FROM events) WHERE file <> 'x.lock' GROUP BY file")
def audit_lockfiles(spark, d):
    return K.audit_lockfiles(chosen(spark, d, ["a/package-lock.json", "uv.lock", "x.lock", "b/Cargo.lock"]).select(F.col("text").alias("file")).distinct())


@query("SELECT 'knip' AS kind, COUNT(*) AS unjudged FROM part UNION ALL SELECT 'deps', COUNT(*) FROM nation")
def missing_baseline(spark, d):
    return K.missing_baseline({"knip": S.table(spark, d, "part"), "deps": S.table(spark, d, "nation")})


@query("SELECT 'not available (' || COUNT(*) || ' of ' || (SELECT COUNT(*) FROM events) || ' request(s): ' || MIN_BY(event_type, event_id) || ')' AS line FROM events WHERE event_id % 2 = 0")
def failed_requests(spark, d):
    e = S.table(spark, d, "events")
    return V.failure_line(e.where("event_id % 2 = 0").select(F.col("event_id").alias("ord"), F.col("event_type").alias("reason")), e.count())


@query("SELECT event_id AS id, LEAST(event_id % 90, 40)::INTEGER AS chars, event_id % 90 > 40 AS cut FROM events")
def clipped_texts(spark, d):
    text = F.repeat(F.lit("x"), (F.col("event_id") % 90).cast("int"))
    clip = V.clip(text, F.lit(40))
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.length(clip).alias("chars"), clip.endswith(V.CUT).alias("cut"))


@query("SELECT event_id AS id, 'note: ' || event_type || ' p=0.25 ' || CASE WHEN event_id % 2 = 0 THEN '<' ELSE '>=' END || ' 0.5  f' || CASE WHEN event_id % 3 > 0 THEN ':' || event_id % 3 ELSE '' END || '  why' AS note FROM events")
def verdict_notes(spark, d):
    e = F.col("event_id")
    rows = S.table(spark, d, "events").select(e.alias("id"), F.col("event_type").alias("question"), F.lit(0.25).alias("p"), (e % 2 == 0).alias("below"), F.lit(0.5).alias("limit"), F.lit("f").alias("file"), (e % 3).alias("at"), F.lit("why").alias("label"))
    return V.note_lines(rows).select("id", "note")


MORE_HUNKS = ["<Card>5</Card> analytics", "if (provider === 'x') y()", "color: \"red\"", "let p = 1", "<b>Hello you</b>", "const prompt = `x`"]


@query("SELECT event_id AS at, CASE event_id % 6 WHEN 0 THEN 'metric_without_deeplink' WHEN 1 THEN 'per_vendor_branch' WHEN 2 THEN 'hardcoded_color' WHEN 4 THEN 'jargon_in_ui' ELSE 'prompt_depends_on_environment' END AS question FROM events WHERE event_id % 6 <> 3 AND NOT (event_id % 6 = 1 AND event_id % 4 = 1) UNION ALL SELECT event_id, 'update_without_rollback' FROM events WHERE event_id % 4 = 2")
def more_review_questions(spark, d):
    file = F.when(F.col("event_id") % 4 == 1, "src/provider.ts").when(F.col("event_id") % 4 == 2, "bin/update.sh").otherwise("a.tsx")
    return V.questions(chosen(spark, d, MORE_HUNKS, file.alias("file")).withColumnRenamed("id", "at")).select("at", "question")


@query("SELECT event_id AS at, UNNEST(CASE event_id % 3 WHEN 0 THEN ['textual_test', 'error_path_tested', 'assertion_weakened'] WHEN 1 THEN ['textual_test', 'error_path_tested', 'mock_hides_behavior'] ELSE ['textual_test', 'error_path_tested', 'property_is_tautology'] END) AS question FROM events")
def test_hunk_questions(spark, d):
    rows = chosen(spark, d, ["expect(1)", "x", "fc.assert(p)"]).select(F.lit("a.test.ts").alias("file"), F.col("id").alias("at"), F.col("text").alias("added"), F.when(F.col("i") == 0, "old").otherwise("").alias("removed"), (F.col("i") == 1).alias("mocks"))
    return V.test_questions(rows, spark.createDataFrame([(True,)], "errors boolean")).select("at", "question")


@query(where_sql(4, [0, 2], "event_id AS doc"))
def weakened_assertions(spark, d):
    pairs = [("assert.equal(x, 1)", "assert.ok(x)"), ("assert.equal(x, 1)", "assert.ok(y)"), ("expect(f(a)).toBe(2)", "expect( f(a) ).toBeTruthy()"), ("y", "expect(a).toBe(1)")]
    pick = lambda k: F.get(F.array(*(F.lit(p[k]) for p in pairs)), (F.col("event_id") % 4).cast("int"))
    return T.weakened_calls(S.table(spark, d, "events").select(F.col("event_id").alias("doc"), pick(0).alias("removed"), pick(1).alias("added")))


@query("SELECT event_id AS line, CASE event_id % 5 WHEN 0 THEN 'load' WHEN 1 THEN 'load' WHEN 2 THEN 'save' END AS name FROM events WHERE event_id % 5 < 3")
def stub_shadows(spark, d):
    rows = chosen(spark, d, ["const load = () => 1", "function mockLoad() {", "let fakeSave = async (a) => b", "const mine = () => 2", "load()"], F.lit("a.test.ts").alias("file"), F.col("event_id").alias("line"))
    names = spark.createDataFrame([("a.test.ts", "load", 0, 0), (None, "save", 1, 0), ("b.test.ts", "mine", 0, 0)], "file string, name string, rank int, ord int")
    return T.stub_shadows(rows, names).select("line", "name")
