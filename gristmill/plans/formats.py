"""Queries over text formats: written from the tables line by line, and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.ordering import dealt
from gristmill.operators import supply as P
from gristmill.plans import standins as S
from gristmill.sources import coverage as V
from gristmill.sources import diffs as D
from gristmill.sources import lockfiles as L
from gristmill.sources import reports as R
from gristmill.sources import testlogs as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def key(name):
    return F.col(name).cast("string")


# Diffs: a file for each order, a hunk for each of its lines.
DIFF_SQL = "x AS (SELECT DISTINCT l_orderkey AS o, l_linenumber * 10 AS n FROM lineitem), c AS (SELECT o % 7 AS doc, 'f' || o AS file, o % 11 = 0 AS deleted, n AS new_start, s.side, CASE WHEN s.side = '-' THEN n + 1 WHEN o % 11 = 0 THEN NULL ELSE n + 1 END AS line, s.side || s.side || ' t' || n AS text, o FROM x, (VALUES ('-'), ('+')) s(side) WHERE s.side = '-' OR (o % 11 <> 0 AND (o + n) % 3 <> 0))"


def diff_lines(spark, d):
    """Context, a removed line that looks like a header, perhaps an added one; deleted files have no added lines."""
    x = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") * 10).alias("n")).repartition("o").distinct()
    o, n = key("o"), key("n")
    gone = F.col("o") % 11 == 0
    adds = ~gone & ((F.col("o") + F.col("n")) % 3 != 0)
    first = F.lag("n").over(__import__("pyspark").sql.Window.partitionBy("o").orderBy("n")).isNull()
    head = F.when(first, F.array(cat("diff --git a/f", o, " b/f", o), F.lit("index 1..2 100644"), cat("--- a/f", o), F.when(gone, "+++ /dev/null").otherwise(cat("+++ b/f", o)))).otherwise(F.array().cast("array<string>"))
    hunk = cat("@@ -", n, ",2 +", n, F.when(adds, ",2").otherwise(",1"), " @@ def f():")
    body = F.concat(F.array(hunk, F.lit(" same"), cat("-- t", n)), F.when(adds, F.array(cat("++ t", n))).otherwise(F.array().cast("array<string>")))
    rows = x.withColumn("doc", F.col("o") % 7).withColumn("lines", F.concat(head, body))
    return S.text_lines(rows.withColumns({"o": F.col("o").cast("bigint"), "n": F.col("n").cast("bigint")}), "doc", ["o", "n"], F.col("lines"))


@query(f"WITH {DIFF_SQL} SELECT doc, file, deleted, new_start, side, line, substr(text, 2) AS text FROM c")
def parsed_diff(spark, d):
    return D.parse_diff(diff_lines(spark, d)).select("doc", "file", "deleted", "new_start", "side", "line", "text")


@query(f"WITH {DIFF_SQL} SELECT doc, file, deleted, new_start, side, line, substr(text, 2) AS text FROM c")
def parsed_large_diff(spark, d):
    return D.parse_large_diff(diff_lines(spark, d)).select("doc", "file", "deleted", "new_start", "side", "line", "text")


@query(f"WITH {DIFF_SQL}, h AS (SELECT doc, file, new_start, bool_or(side = '+') AS adds FROM c GROUP BY ALL) SELECT doc, file, line FROM c WHERE side = '+' UNION SELECT doc, file, UNNEST([new_start, new_start + 1]) FROM h WHERE NOT adds")
def touched_lines(spark, d):
    return D.touched_lines(D.parse_diff(diff_lines(spark, d)))


@query(f"WITH {DIFF_SQL} SELECT doc, file, new_start AS at, substr(text, 2) AS text FROM c WHERE side = '+'")
def review_hunks(spark, d):
    return D.review_hunks(D.parse_diff(diff_lines(spark, d))).select("doc", "file", "at", "text")


@query(f"WITH {S.DOC_LINE_SQL} SELECT doc_id % 10 AS g, COUNT(*) AS lines, SUM(line)::BIGINT AS sum_line FROM doc_line GROUP BY 1")
def whole_files(spark, d):
    files = S.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    return D.whole_files(files).groupBy((F.col("file") % 10).alias("g")).agg(F.count("*").alias("lines"), F.sum("line").alias("sum_line"))


@query("WITH a AS (SELECT l_orderkey AS file, l_linenumber AS line, l_returnflag || l_partkey AS text, l_partkey * 1000 + l_suppkey AS range_ord FROM lineitem), u AS (SELECT file, line, range_ord, MAX(text) AS text FROM a GROUP BY ALL) SELECT file, line, MAX_BY(text, range_ord) AS text FROM u GROUP BY file, line")
def union_of_ranges(spark, d):
    table = S.table(spark, d, "lineitem")
    a = table.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", key("l_partkey")).alias("text"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("range_ord"))
    a = dealt(a, table.count(), "file", "line").groupBy("file", "line", "range_ord").agg(F.max("text").alias("text"))
    return D.union_changes(a.where("range_ord % 2 = 0"), a.where("range_ord % 2 = 1"))


def lcov_lines(spark, d):
    table = S.table(spark, d, "lineitem")
    x = dealt(table.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), table.count(), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", 0).otherwise(F.floor("l_quantity").cast("long")).alias("h")))).alias("l"))
    body = F.transform("l", lambda r: cat("DA:", r["l_linenumber"].cast("string"), ",", r["h"].cast("string")))
    broken = F.col("l_orderkey") % 13 == 0
    lines = F.concat(F.array(F.lit("TN:"), cat("SF:/repo/o", key("l_orderkey"))), body, F.when(broken, F.array(F.lit("DA:1,x"))).otherwise(F.array(F.lit("LF:1"))), F.array(F.lit("end_of_record")))
    return x.withColumn("lines", lines).withColumn("doc", F.col("l_orderkey") % 50)


@query(f"WITH {S.HITS_SQL} SELECT file, line, hits FROM hits")
def lcov_hits(spark, d):
    rows = S.text_lines(lcov_lines(spark, d).withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")), "doc", ["l_orderkey"], F.col("lines"))
    return V.parse_lcov(rows, "/repo").select("file", "line", "hits")


@query(f"WITH {S.HITS_SQL} SELECT file, line, hits FROM hits")
def large_lcov_hits(spark, d):
    rows = S.text_lines(lcov_lines(spark, d).withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")), "doc", ["l_orderkey"], F.col("lines"))
    return V.parse_large_lcov(rows, "/repo").select("file", "line", "hits")


@query("SELECT l_orderkey % 50 AS doc, MAX(CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END) = 0 AS valid FROM lineitem GROUP BY 1")
def lcov_validity(spark, d):
    rows = S.text_lines(lcov_lines(spark, d), "doc", ["l_orderkey"], F.col("lines"))
    return V.valid_lcov(rows)


@query("SELECT p_partkey AS ord, 'src/' || p_brand || '.c' AS file, 'f\"' || p_partkey || '\", g' AS name, CAST(p_size AS INTEGER) AS cc, CAST(p_size AS INTEGER) AS start, CAST(p_size + 5 AS INTEGER) AS \"end\" FROM part WHERE p_partkey % 9 <> 0")
def complexity_csv(spark, d):
    p = S.table(spark, d, "part")
    size = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(key("p_size"))
    line = cat("5,", size, ',10,1,9,"loc",src/', F.col("p_brand"), '.c,"f""', key("p_partkey"), '"", g",f(a),', key("p_size"), ",", (F.col("p_size") + 5).cast("string"))
    return V.parse_complexity_csv(p.select(F.col("p_partkey").alias("ord"), line.alias("text")))


@query("SELECT 'a' || p_partkey || '.py' AS file, UNNEST(['m' || p_partkey, 'inner']) AS name, CAST(UNNEST([p_size, 1]) AS INTEGER) AS cc FROM part UNION ALL SELECT 'a' || p_partkey || '.py', 'top', 2 FROM part")
def complexity_json(spark, d):
    k, n = key("p_partkey"), key("p_size")
    text = cat('{"a', k, '.py": [{"type": "class", "name": "C", "methods": [{"type": "method", "name": "m', k, '", "lineno": 2, "endline": 9, "col_offset": 4, "complexity": ', n, ', "closures": [{"type": "function", "name": "inner", "lineno": 3, "endline": 4, "complexity": 1, "closures": []}]}]}, {"type": "function", "name": "top", "lineno": 20, "endline": 21, "complexity": 2}]}')
    return V.parse_complexity_json(S.table(spark, d, "part").select(text.alias("text"))).select("file", "name", "cc")


LOG_SQL = "e AS (SELECT event_id AS id, event_id % 5 AS k, event_id % 17 AS a, event_id % 3 AS b FROM events)"


@query(f"WITH {LOG_SQL} SELECT id, CASE WHEN k < 4 THEN CAST(a + b AS INTEGER) END AS ran, CASE WHEN k < 4 THEN CAST(b AS INTEGER) END AS failed, CASE WHEN k = 4 THEN 'no pytest test summary in the log' END AS error FROM e")
def test_summaries(spark, d):
    a, b = F.col("event_id") % 17, F.col("event_id") % 3
    both = (a + b).cast("string")
    log = (
        F.when(F.col("k") == 0, cat("# tests 99\n\x1b[32mℹ tests ", both, "\x1b[0m\nℹ pass 1\nℹ fail ", b.cast("string"), "\n"))
        .when(F.col("k") == 1, cat(" ", a.cast("string"), " pass\n ", b.cast("string"), " fail\nRan ", both, " tests across 2 files."))
        .when(F.col("k") == 2, cat(" Test Files  1 passed (1)\n      Tests  ", b.cast("string"), " failed | ", a.cast("string"), " passed (", both, ")\n"))
        .when(F.col("k") == 3, cat("==== ", b.cast("string"), " failed, ", a.cast("string"), " passed in 0.12s ===="))
        .otherwise("nothing to see")
    )
    runner = F.get(F.array(*map(F.lit, ["node", "bun", "vitest", "py", "py"])), F.col("k"))
    rows = S.table(spark, d, "events").withColumn("k", (F.col("event_id") % 5).cast("int")).select(F.col("event_id").alias("id"), runner.alias("runner"), log.alias("log"))
    return T.parse_summaries(rows).select("id", "ran", "failed", "error")


@query(f"WITH {LOG_SQL} SELECT id, CAST(CASE WHEN k = 0 THEN b WHEN k = 1 THEN b + 4 END AS INTEGER) AS failed FROM e")
def failed_tests(spark, d):
    b = (F.col("event_id") % 3).cast("string")
    log = F.when(F.col("event_id") % 5 == 0, cat(b, " failed, 3 passed in 1.5s")).when(F.col("event_id") % 5 == 1, cat("job: ", b, " failed; other: 4 failed")).otherwise("ok")
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), T.count_failed(log).alias("failed"))


RUN_SQL = "r AS (SELECT event_id AS id, event_id % 2 AS code, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS failed, event_id % 7 <> 0 AS lcov_valid, event_id % 11 = 0 AS timed_out FROM events)"


@query(f"WITH {RUN_SQL} SELECT id, code <> 0 OR COALESCE(failed, 0) > 0 AS red, CASE WHEN timed_out THEN 'tests/timeout' WHEN code <> 0 OR COALESCE(failed, 0) > 0 THEN 'tests/red' WHEN NOT lcov_valid THEN 'coverage/invalid' ELSE 'pass' END AS verdict FROM r")
def run_verdicts(spark, d):
    e = F.col("event_id")
    rows = S.table(spark, d, "events").select(e.alias("id"), (e % 2).alias("code"), F.when(e % 5 != 0, e % 3).alias("failed"), (e % 7 != 0).alias("lcov_valid"), (e % 11 == 0).alias("timed_out"))
    return T.run_state(rows).select("id", "red", "verdict")


@query("WITH r AS (SELECT event_id AS id, event_id % 4 AS ran, event_id % 2 AS failed, event_id % 3 AS code FROM events) SELECT id, CASE WHEN ran = 0 THEN 'error' WHEN failed > 0 THEN 'killed' WHEN code = 0 THEN 'survived' ELSE 'error' END AS outcome FROM r")
def mutant_outcomes(spark, d):
    e = F.col("event_id")
    return T.mutant_outcome(S.table(spark, d, "events").select(e.alias("id"), (e % 4).alias("ran"), (e % 2).alias("failed"), (e % 3).alias("code"))).select("id", "outcome")


# Lock files: one for each brand, a package for each part.
LOCK_SQL = "p AS (SELECT p_brand AS doc, 'n' || p_partkey AS name, p_size || '.0.' || p_partkey % 10 AS version, p_partkey AS k FROM part)"


def packages(spark, d, lines, head=None, tail=None):
    p = S.table(spark, d, "part").select(F.col("p_brand").alias("doc"), cat("n", key("p_partkey")).alias("name"), cat(key("p_size"), ".0.", (F.col("p_partkey") % 10).cast("string")).alias("version"), F.col("p_partkey").cast("bigint").alias("k"))
    rows = p.withColumn("lines", lines(F.col("name"), F.col("version"), F.col("k")))
    ends = p.select("doc").distinct()
    for k, text in ((-1, head), (2**40, tail)):
        if text:
            rows = rows.unionByName(ends.select("doc", F.lit("").alias("name"), F.lit("").alias("version"), F.lit(k).cast("bigint").alias("k"), F.array(*map(F.lit, text)).alias("lines")))
    return S.text_lines(rows, "doc", ["k"], F.col("lines"))


@query(f"WITH {LOCK_SQL} SELECT doc, CASE WHEN k % 3 = 0 THEN '@s/' || name ELSE name END AS name, version, CAST(4 + 5 * (ROW_NUMBER() OVER (PARTITION BY doc ORDER BY k) - 1) AS INTEGER) AS line FROM p QUALIFY k % 5 <> 0")
def npm_lock(spark, d):
    def lines(name, version, k):
        path = F.when(k % 3 == 0, cat("node_modules/a/node_modules/@s/", name)).otherwise(cat("node_modules/", name))
        source = F.when(k % 5 == 0, '      "link": true,').otherwise('      "resolved": "https://r/x.tgz",')
        return F.array(cat('    "', path, '": {'), cat('      "version": "', version, '",'), source, F.lit('      "dev": true'), F.lit("    },"))

    return L.parse_package_lock(packages(spark, d, lines, ["{", '  "lockfileVersion": 3,', '  "packages": {'], ["  }", "}"])).select("doc", "name", "version", "line")


@query(f"WITH {LOCK_SQL} SELECT doc, '@s/' || name AS name, version, CAST(2 + ROW_NUMBER() OVER (PARTITION BY doc ORDER BY k) AS INTEGER) AS line FROM p QUALIFY k % 4 <> 0")
def bun_lock(spark, d):
    def lines(name, version, k):
        return F.array(cat('    "@s/', name, '": ["@s/', name, "@", F.when(k % 4 == 0, "workspace:x").otherwise(version), '", "", {}],'))

    return L.parse_bun_lock(packages(spark, d, lines, ["{", '  "packages": {'], ["  },", '    "x": ["late@1.0.0"],'])).select("doc", "name", "version", "line")


@query(f"WITH {LOCK_SQL} SELECT doc, '@s/' || name AS name, version, CAST(3 + 2 * (ROW_NUMBER() OVER (PARTITION BY doc ORDER BY k) - 1) AS INTEGER) AS line FROM p")
def pnpm_lock(spark, d):
    def lines(name, version, k):
        return F.array(cat("  '@s/", name, "@", version, "(peer@1.0.0)':"), F.lit("    resolution: {integrity: x}"))

    return L.parse_pnpm_lock(packages(spark, d, lines, ["lockfileVersion: '9.0'", "packages:"], ["snapshots:", "  late@1.0.0:"])).select("doc", "name", "version", "line")


@query(f"WITH {LOCK_SQL} SELECT doc, name, version, CAST(2 + 5 * (ROW_NUMBER() OVER (PARTITION BY doc ORDER BY k) - 1) AS INTEGER) AS line FROM p QUALIFY k % 6 <> 0")
def python_lock(spark, d):
    def lines(name, version, k):
        source = F.when(k % 6 == 0, 'source = { editable = "." }').otherwise('source = { registry = "https://pypi.org/simple" }')
        return F.array(F.lit("[[package]]"), cat('name = "', name, '"'), cat('version = "', version, '"'), source, F.lit(""))

    return L.parse_python_lock(packages(spark, d, lines, ["version = 1"]), True).select("doc", "name", "version", "line")


@query("WITH r AS (SELECT 'f' || p_size % 4 AS file, p_brand AS name, p_size || '.1' AS version, p_partkey AS line FROM part), a AS (SELECT DISTINCT p_partkey AS line, 'f' || p_size % 4 AS file FROM part WHERE p_partkey % 3 = 0) SELECT name, version, MAX(file) AS file FROM r JOIN a USING (file, line) GROUP BY name, version")
def changed_lock_records(spark, d):
    p = S.table(spark, d, "part")
    file = cat("f", (F.col("p_size") % 4).cast("string"))
    rec = p.select(file.alias("file"), F.col("p_brand").alias("name"), cat(key("p_size"), ".1").alias("version"), F.col("p_partkey").alias("line"), F.col("p_partkey").alias("end"), F.lit("npm").alias("registry"))
    return P.changed_records(rec, p.where("p_partkey % 3 = 0").select(file.alias("file"), F.col("p_partkey").alias("line"))).select("name", "version", "file")


@query("WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS p, o_orderdate AS t FROM orders) SELECT k, CASE WHEN p IS NULL THEN 'unknown' WHEN p = 'soon' THEN 'bad-date' ELSE 'young' END AS verdict, CASE WHEN p <> 'soon' THEN GREATEST(CAST(FLOOR(epoch(TIMESTAMP '1998-06-01' - t) / 3600) AS BIGINT), 0) END AS hours FROM r WHERE p IS NULL OR p = 'soon' OR t > TIMESTAMP '1998-05-02'")
def young_versions(spark, d):
    o = S.table(spark, d, "orders")
    rec = o.select(F.lit("npm").alias("registry"), key("o_orderkey").alias("name"), F.lit("1.0").alias("version"), F.col("o_orderkey").alias("k"))
    stamp = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    known = o.where("o_orderkey % 5 <> 0").select(cat("npm:", key("o_orderkey"), "@1.0").alias("key"), stamp.alias("published"))
    return P.young_records(rec, known, F.lit("1998-06-01 00:00:00"), 30).select("k", "verdict", "hours")


@query("SELECT DISTINCT o_custkey AS file, o_orderpriority AS name FROM orders EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def new_packages(spark, d):
    o = S.table(spark, d, "orders")
    pick = lambda x: x.select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"))
    return P.new_packages(pick(o), pick(o.where("o_orderstatus = 'F'")))


@query("SELECT p_partkey AS file, UNNEST(['a', 'b', 'c']) AS name, UNNEST(['^' || p_size, '1.' || p_size, '~2']) AS range FROM part")
def npm_manifests(spark, d):
    n = key("p_size")
    text = cat('{"name": "x", "dependencies": {"a": "^', n, '", "b": "1.', n, '"}, "devDependencies": {"b": "9", "c": "~2"}}')
    return P.npm_dependencies(S.table(spark, d, "part").select(F.col("p_partkey").alias("file"), text.alias("text")))


@query("SELECT 'p' || p_partkey AS file, UNNEST(['req', 'extra', 'grp', 'poet']) AS name, UNNEST(['>=' || p_size, '', '==1', '^' || p_size]) AS range FROM part")
def python_manifests(spark, d):
    n = key("p_size")
    text = cat('[project]\ndependencies = ["req>=', n, '"]\n[project.optional-dependencies]\nx = ["extra"]\n[dependency-groups]\ndev = ["grp==1"]\n[tool.poetry.dependencies]\npython = "^3"\npoet = "^', n, '"\n')
    return P.python_dependencies(S.table(spark, d, "part").select(cat("p", key("p_partkey")).alias("file"), text.alias("text")))


@query("SELECT p_partkey AS file, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS fresh FROM part")
def cached_audits(spark, d):
    p = S.table(spark, d, "part")
    lock = p.select(F.col("p_partkey").alias("file"), F.col("p_name").alias("_n"), F.concat("p_name", key("p_partkey")).alias("text"), F.when(F.col("p_partkey") % 2 == 0, "osv").otherwise("npm").alias("tool"))
    cache = lock.where("file % 3 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit("osv").alias("tool"))
    return P.cached_audits(lock, cache).select("file", "fresh")


@query(
    """WITH f AS (SELECT sha1(CAST(doc_id AS VARCHAR)) AS n, sha1(text) AS t FROM documents), h AS (SELECT n[1:3] AS b, sha1(n || ':' || COALESCE(t, 'null')) AS h FROM f),
    k AS (SELECT b, sha1(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY b) SELECT sha1(string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS sha1 FROM k"""
)
def source_fingerprint(spark, d):
    return P.fingerprint(S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))


@query("SELECT 'h' || o_orderkey AS head, CASE WHEN o_orderkey % 5 <> 0 THEN 'b' || o_orderkey END AS base FROM orders WHERE o_orderkey % 3 <> 0")
def push_ranges(spark, d):
    o = F.col("o_orderkey")
    text = cat("refs/heads/x ", F.when(o % 3 == 0, "0000").otherwise(cat("h", key("o_orderkey"))), " refs/heads/x ", F.when(o % 5 == 0, "0000").otherwise(cat("b", key("o_orderkey"))))
    return P.push_ranges(S.table(spark, d, "orders").select(text.alias("text")))


def json_events(spark, d, *values):
    return S.table(spark, d, "events").select(*(v.alias(f"v{i}") for i, v in enumerate(values)))


@query("SELECT 'form/' || COALESCE(CASE WHEN event_id % 4 > 0 THEN event_type END, 'finding') AS rule, 'a b/u' || user_id AS file, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 100 END AS INTEGER) AS line, 'm' || event_id AS msg FROM events")
def sarif_report(spark, d):
    e = F.col("event_id")
    region = F.when(e % 3 == 0, "{}").otherwise(cat('{"startLine": ', (e % 100).cast("string"), "}"))
    rule = F.when(e % 4 > 0, cat('"ruleId": "', F.col("event_type"), '", ')).otherwise("")
    text = cat('{"version": "2.1.0", "runs": [{"results": [{', rule, '"message": {"text": "m', key("event_id"), '"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file://./a%20b/u', key("user_id"), '"}, "region": ', region, "}}]}]}, {}]}")
    return R.parse_sarif(S.table(spark, d, "events").select(text.alias("text")), "form")


@query("SELECT DISTINCT 'deps/audit' AS rule, 'l' || event_id % 5 AS file, 0 AS line, 'n' || user_id || '@1.' || event_id % 2 || ': V-' || event_type AS msg FROM events")
def osv_report(spark, d):
    e = F.col("event_id")
    text = cat('{"results": [{"source": {"path": "l', (e % 5).cast("string"), '"}, "packages": [{"package": {"name": "n', key("user_id"), '", "version": "1.', (e % 2).cast("string"), '"}, "vulnerabilities": [{"id": "V-', F.col("event_type"), '"}]}]}]}')
    return R.parse_osv(S.table(spark, d, "events").select(text.alias("text")))


@query("SELECT 'form/clippy::' || event_type AS rule, 's' || user_id || '.rs' AS file, CAST(event_id % 100 AS INTEGER) AS line, 'long' AS msg FROM events WHERE event_id % 3 = 0")
def clippy_report(spark, d):
    e = F.col("event_id")
    text = cat('{"reason": "', F.when(e % 3 == 1, "build-finished").otherwise("compiler-message"), '", "message": {"code": {"code": "', F.when(e % 3 == 2, "dead_code").otherwise(cat("clippy::", F.col("event_type"))), '"}, "message": "long", "spans": [{"file_name": "other.rs", "line_start": 1, "is_primary": false}, {"file_name": "s', key("user_id"), '.rs", "line_start": ', (e % 100).cast("string"), ', "is_primary": true}]}}')
    return R.parse_clippy(S.table(spark, d, "events").select(text.alias("text")))


@query("SELECT 'form/gocyclo' AS rule, 'p/u' || user_id || '.go' AS file, CAST(event_id % 100 AS INTEGER) AS line, 'Run' || event_type || ' has complexity ' || (11 + event_id % 9) AS msg FROM events WHERE event_id % 4 > 0")
def gocyclo_report(spark, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "Average: 3").otherwise(cat((11 + e % 9).cast("string"), " main Run", F.col("event_type"), " p/u", key("user_id"), ".go:", (e % 100).cast("string"), ":1"))
    return R.parse_gocyclo(S.table(spark, d, "events").select(text.alias("text")))


@query("SELECT 'deps/cycle' AS rule, CASE WHEN event_id % 3 = 0 THEN 'a' || user_id || '.rb' ELSE '.' END AS file, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE 0 END AS INTEGER) AS line, CASE WHEN event_id % 3 = 0 THEN 'bad: thing' ELSE 'Circular import ' || event_id END AS msg FROM events WHERE event_id % 3 < 2")
def text_report(spark, d):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, cat("a", key("user_id"), ".rb:", (e % 50).cast("string"), ":7: bad: thing")).when(e % 3 == 1, cat(" Circular import ", key("event_id"))).otherwise("all fine")
    return R.parse_text(S.table(spark, d, "events").select(text.alias("text")), "deps/cycle")


@query("SELECT DISTINCT 'dead/' || UNNEST([event_type, 'finding']) AS rule, UNNEST(['f' || user_id, 'deep']) AS file, CAST(UNNEST([event_id % 9, 3]) AS INTEGER) AS line, UNNEST(['m', 'why']) AS msg FROM events")
def generic_report(spark, d):
    e = F.col("event_id")
    one = cat('{"rule": "', F.col("event_type"), '", "path": "f', key("user_id"), '", "lineNumber": ', (e % 9).cast("string"), ', "message": "m", "more": [{"x": {"reason": "why", "location": {"file": "deep", "row": 3}}}]}')
    return R.parse_generic(S.table(spark, d, "events").select(cat(one, "\n", one).alias("text")), "dead")


@query("SELECT 'dead/cargo-machete' AS rule, 'c' || p_partkey || '/Cargo.toml' AS file, 0 AS line, 'k' || p_partkey || ': unused dependency ' || UNNEST(['a', 'b']) AS msg FROM part")
def machete_report(spark, d):
    k = key("p_partkey")
    text = cat('{"crates": [{"manifest_path": "c', k, '/Cargo.toml", "package_name": "k', k, '", "unused": ["a", "b"]}]}')
    return R.parse_machete(S.table(spark, d, "part").select(text.alias("text")))


@query("SELECT 'dead/deadcode' AS rule, 'g' || p_partkey || '.go' AS file, CAST(p_size AS INTEGER) AS line, 'ex.com/' || p_partkey || '.Run is unreachable' AS msg FROM part")
def deadcode_report(spark, d):
    k = key("p_partkey")
    text = cat('[{"Name": "main", "Path": "ex.com/', k, '", "Funcs": [{"Name": "Run", "Position": {"File": "g', k, '.go", "Line": ', key("p_size"), "}}]}]")
    return R.parse_deadcode(S.table(spark, d, "part").select(text.alias("text")))


@query("SELECT DISTINCT 'deps/cycle' AS rule, 'go.mod' AS file, 0 AS line, CASE WHEN p_partkey % 3 = 0 THEN 'import cycle: a -> b' || p_size ELSE 'import cycle: import cycle not allowed' END AS msg FROM part WHERE p_partkey % 3 < 2")
def go_cycles(spark, d):
    k = F.col("p_partkey") % 3
    error = F.when(k == 0, cat('"DepsErrors": [{"ImportStack": ["a", "b', key("p_size"), '"], "Err": "x"}]')).when(k == 1, '"Error": {"Err": "import cycle not allowed"}').otherwise('"Error": {"Err": "no such package"}')
    return R.parse_go_cycles(S.table(spark, d, "part").select(cat('{"ImportPath": "p", ', error, '}\n{"ImportPath": "q"}').alias("text")))


@query("WITH c AS (SELECT o_orderkey AS ord, 'm' || o_custkey % 5 AS a, 'm' || o_orderkey % 4 AS b FROM orders) SELECT LEAST(a, b) || CASE WHEN a = b THEN '' ELSE '|' || GREATEST(a, b) END AS key, MAX_BY(a || ' -> ' || b || ' -> ' || a, ord) AS text FROM c GROUP BY 1")
def cycle_keys(spark, d):
    a, b = (cat("m", (F.col(c) % n).cast("string")) for c, n in (("o_custkey", 5), ("o_orderkey", 4)))
    return R.cycle_keys(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.array(a, b, a).alias("nodes")))


@query("SELECT p_brand AS kind, COUNT(*) AS n, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS names FROM part GROUP BY 1")
def dead_summary(spark, d):
    return R.dead_summary(S.table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("name"))).withColumn("names", F.array_join("names", " "))


@query("SELECT SUM(p_size + 1)::BIGINT AS packages FROM part")
def packages_scanned(spark, d):
    return R.packages_scanned(S.table(spark, d, "part").select(cat("found ", key("p_size"), " packages\nfound 1 package").alias("text")))


@query("SELECT DISTINCT 'n' || o_custkey AS package, 'V' || o_orderkey % 9 AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' ELSE 'high' END AS severity FROM orders WHERE o_orderpriority < '3' AND o_orderkey % 4 > 0")
def vulnerabilities(spark, d):
    p = F.col("o_orderpriority")
    severity = F.when(p.startswith("1"), "CRITICAL").when(p < "3", "high").otherwise("low")
    rows = S.table(spark, d, "orders").select(cat("n", key("o_custkey")).alias("package"), F.when(F.col("o_orderkey") % 4 > 0, cat("V", (F.col("o_orderkey") % 9).cast("string"))).alias("id"), severity.alias("severity"))
    return R.vulnerabilities(rows)
