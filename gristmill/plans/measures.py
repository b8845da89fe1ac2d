"""Queries over coverage, complexity, ratchets and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import complexity as C
from gristmill.operators import graph as G
from gristmill.operators import ratchet as R
from gristmill.operators import tamper as T
from gristmill.plans import standins as S
from gristmill.sources import coverage as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scored(spark, d):
    return C.score(S.functions(spark, d), S.hits(spark, d))


@query(f"WITH {S.SCORED_SQL}, {S.TOUCHED_SQL} SELECT ord, file, name, cc, cov, crap FROM risky WHERE (cc > 10 OR risk > 30) AND ord IN (SELECT ord FROM own JOIN touched USING (file, line) UNION SELECT ord FROM fn JOIN touched USING (file) WHERE line = 1)")
def changed_function_crap(spark, d):
    """Functions on changed lines over a bar."""
    near = C.changed(S.functions(spark, d), S.touched(spark, d))
    return C.over_bar(C.score(near, S.hits(spark, d))).select("ord", "file", "name", "cc", "cov", "crap")


@query(f"WITH {S.SCORED_SQL} SELECT ord, cov, crap FROM scored")
def function_scores(spark, d):
    return scored(spark, d).select("ord", "cov", "crap")


@query(f"WITH {S.SCORED_SQL} SELECT ROUND(COALESCE(AVG(risk), 0), 6) AS mean_crap FROM risky")
def mean_crap(spark, d):
    return C.mean_risk(scored(spark, d)).select(F.round("mean_crap", 6).alias("mean_crap"))


@query(f"WITH {S.SCORED_SQL} SELECT ROUND(AVG(risk), 6) AS mean_crap FROM risky HAVING AVG(risk) > 8 AND AVG(risk) > 20.5")
def mean_crap_drift(spark, d):
    return C.mean_drift(scored(spark, d), 20.0, 8.0, 0.5).select(F.round("mean_crap", 6).alias("mean_crap"))


@query(f"WITH {S.SCORED_SQL}, s AS (SELECT list_sort(list(risk)) AS l FROM risky) SELECT COUNT(*) AS functions, COUNT(*) FILTER (crap IS NULL) AS without_data, ROUND(AVG(risk), 6) AS mean_crap, COUNT(*) FILTER (risk > 30) AS over_crap, COUNT(*) FILTER (cc > 10) AS over_cc, (SELECT l[len(l) // 2 + 1] FROM s) AS median_crap FROM risky")
def crap_statistics(spark, d):
    return C.statistics(scored(spark, d)).withColumn("mean_crap", F.round("mean_crap", 6))


ACTION_SQL = "CASE WHEN cc <= 8 THEN CASE WHEN COALESCE(cov, 0) < 1 THEN 'tests' END WHEN COALESCE(cov, 0) < 1 THEN 'tests+split' ELSE 'split' END"


@query(f"WITH {S.SCORED_SQL}, {S.CHURN_SQL}, w AS (SELECT ord, file, name, risk * GREATEST(1, COALESCE(commits, 0)) AS risk, {ACTION_SQL} AS action, risk AS r FROM risky LEFT JOIN churn USING (file)) SELECT ord, file, name, risk, action FROM w WHERE r > 8 AND action IS NOT NULL ORDER BY risk DESC, ord LIMIT 10")
def worklist_top10(spark, d):
    return C.worklist(scored(spark, d), S.churn(spark, d))


@query(f"WITH {S.SCORED_SQL}, {S.CHURN_SQL}, f AS (SELECT file, COUNT(*) AS risky, SUM(risk) AS crap FROM risky WHERE risk > 8 OR cc > 10 GROUP BY file) SELECT file, risky, crap, COALESCE(commits, 0) AS commits, crap * COALESCE(commits, 0) AS score FROM f LEFT JOIN churn USING (file) ORDER BY score DESC, file LIMIT 15")
def hotspots_top15(spark, d):
    return C.hotspots(scored(spark, d), S.churn(spark, d))


@query(f"WITH {S.SCORED_SQL} SELECT ord, file, name, risk FROM risky ORDER BY risk DESC, ord LIMIT 30")
def top_risky_30(spark, d):
    return C.top_risky(scored(spark, d))


@query(f"WITH {S.CHURN_SQL} SELECT * FROM churn")
def churn(spark, d):
    return S.churn(spark, d)


@query("WITH n AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS file, o_orderpriority AS name FROM orders), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file, name ORDER BY ord) - 1 AS i FROM n) SELECT ord, file || '::' || name || CASE WHEN i = 0 THEN '' ELSE '#' || i END AS key FROM k")
def function_keys(spark, d):
    rows = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey")).alias("file"), F.col("o_orderpriority").alias("name"))
    return C.numbered_keys(rows).select("ord", "key")


@query(f"WITH {S.SCORED_SQL}, b AS (SELECT o_orderkey AS ord, CAST(1 + o_orderkey % 15 - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS base_cc, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 15 AS DOUBLE) END AS base_crap FROM orders WHERE o_orderstatus = 'F') SELECT ord, cc, base_cc, crap, base_crap FROM scored JOIN b USING (ord) WHERE cc > base_cc OR COALESCE(crap, 0) > COALESCE(base_crap, 'infinity'::DOUBLE) + 0.01")
def baseline_drift(spark, d):
    o = S.table(spark, d, "orders").where("o_orderstatus = 'F'")
    base = o.select(S.order_file().alias("key"), (1 + F.col("o_orderkey") % 15 - F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("int").alias("cc"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 15).cast("double")).alias("crap"))
    return C.drifted(scored(spark, d).withColumn("key", F.col("file")), base).select("ord", "cc", "base_cc", "crap", "base_crap")


@query(f"WITH {S.HITS_SQL}, {S.TOUCHED_SQL}, b AS (SELECT * FROM touched JOIN hits USING (file, line)) SELECT COUNT(*) FILTER (hits > 0) AS covered, COUNT(*) AS total, COALESCE(COUNT(*) FILTER (hits > 0) / COUNT(*), 1.0) AS rate, COUNT(*) FILTER (hits > 0) / COUNT(*) < 0.8 AS fails, (SELECT string_agg(file || ':' || line, ' ' ORDER BY file, line) FROM (SELECT * FROM b WHERE hits = 0 ORDER BY file, line LIMIT 20)) AS uncovered FROM b")
def diff_coverage(spark, d):
    return C.diff_coverage(S.touched(spark, d), S.hits(spark, d)).withColumn("uncovered", F.array_join("uncovered", " "))


@query(f"WITH {S.HITS_SQL}, {S.TOUCHED_SQL} SELECT DISTINCT file FROM touched WHERE file NOT IN (SELECT file FROM hits WHERE line > 3)")
def uncovered_files(spark, d):
    return C.uncovered_files(S.touched(spark, d), S.hits(spark, d).where("line > 3"))


@query(f"WITH {S.TOUCHED_SQL}, r AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS file, 1 + o_orderkey % 5 AS a, 2 + o_orderkey % 5 AS b FROM orders) SELECT ord, file FROM r WHERE EXISTS (SELECT 1 FROM touched t WHERE t.file = r.file AND t.line BETWEEN a AND b)")
def touched_ranges(spark, d):
    """Ranges with a touched line: clones, matches and lock records alike."""
    r = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), S.order_file().alias("file"), (1 + F.col("o_orderkey") % 5).alias("start"), (2 + F.col("o_orderkey") % 5).alias("end"))
    return C.overlapping(r, S.touched(spark, d)).select("ord", "file")


SPANS_SQL = "s AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS file, CAST(1 + o_orderkey % 7 AS INTEGER) AS a, CAST(1 + o_orderkey % 7 + o_orderkey % 11 AS INTEGER) AS b FROM orders)"


def spans(spark, d):
    n = F.col("o_orderkey")
    return S.table(spark, d, "orders").select(n.alias("ord"), F.concat(F.lit("c"), F.col("o_custkey")).alias("file"), (1 + n % 7).cast("int").alias("start"), (1 + n % 7 + n % 11).cast("int").alias("end"))


@query(f"WITH {SPANS_SQL} SELECT s.ord, COUNT(g.ord) AS n, COALESCE(SUM(g.a * 100 + g.b), 0)::BIGINT AS digest FROM s LEFT JOIN s g ON g.file = s.file AND g.a > s.a AND g.b <= s.b GROUP BY s.ord")
def nested_ranges(spark, d):
    rows = C.nested_ranges(spans(spark, d))
    return rows.select("ord", F.size("nested").cast("long").alias("n"), F.aggregate("nested", F.lit(0).cast("long"), lambda a, x: a + x["a"] * 100 + x["b"]).alias("digest"))


@query(f"WITH {SPANS_SQL}, u AS (SELECT file, a, b, MAX(ord) AS ord FROM s GROUP BY ALL), t AS (SELECT file, a, MAX(ord) AS ord, MAX_BY(b, ord) AS b FROM u GROUP BY ALL), m AS (SELECT DISTINCT 'c' || o_custkey AS file, CAST(3 + o_orderkey % 6 AS INTEGER) AS line FROM orders) SELECT m.file, m.line, MAX_BY('f' || t.ord, t.a) AS owner FROM m JOIN t ON t.file = m.file AND m.line BETWEEN t.a AND t.b GROUP BY ALL")
def innermost_owner(spark, d):
    s = spans(spark, d).groupBy("file", "start", "end").agg(F.max("ord").alias("ord")).groupBy("file", "start").agg(F.max("ord").alias("ord"), F.max_by("end", "ord").alias("end"))
    m = S.table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("file"), (3 + F.col("o_orderkey") % 6).cast("int").alias("line")).distinct()
    return C.innermost(s.withColumn("name", F.concat(F.lit("f"), F.col("ord"))), m)


@query("WITH f AS (SELECT o_custkey AS file, o_orderkey % 3 AS start, o_orderkey AS col FROM orders), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file, start ORDER BY col) AS n FROM f), b AS (SELECT file, start, col, ROW_NUMBER() OVER (PARTITION BY file, start ORDER BY col) AS n FROM f WHERE col % 2 = 0) SELECT a.col AS col, b.col AS cc FROM a JOIN b USING (file, start, n)")
def matched_messages(spark, d):
    f = S.table(spark, d, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 3).alias("start"), F.col("o_orderkey").alias("col"))
    m = f.where("col % 2 = 0").select("file", F.col("start").alias("line"), "col", F.col("col").alias("cc"))
    return V.match_messages(f, m).select("col", "cc")


ITEMS_SQL = "now AS (SELECT 'part' AS kind, p_brand || ' ' || p_size AS name FROM part), known AS (SELECT 'part' AS kind, p_brand || ' ' || p_size AS name FROM part WHERE p_partkey % 3 = 0)"


def items(spark, d, known=False):
    p = S.table(spark, d, "part").where("p_partkey % 3 = 0" if known else "true")
    return p.select(F.lit("part").alias("kind"), F.concat_ws(" ", "p_brand", "p_size").alias("name"))


@query(f"WITH {ITEMS_SQL} SELECT * FROM now WHERE name NOT IN (SELECT name FROM known)")
def new_dead_items(spark, d):
    return R.new_items(items(spark, d), items(spark, d, True), ["kind", "name"])


@query(f"WITH {ITEMS_SQL} SELECT COUNT(*) AS unjudged FROM now")
def unjudged_items(spark, d):
    return R.unjudged(items(spark, d), None)


FIND_SQL = "f AS (SELECT event_id AS ord, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS rule, 'u' || user_id AS file, CAST(event_id % 3 AS INTEGER) AS line, 'm' || event_id % 5 AS msg, 'a' || event_id % 2 AS adapter, 'form' AS kind FROM events)"


def findings(spark, d):
    e = F.col("event_id")
    return S.table(spark, d, "events").select(
        e.alias("ord"), F.when(e % 7 != 0, F.col("event_type")).alias("rule"), F.concat(F.lit("u"), F.col("user_id")).alias("file"), (e % 3).cast("int").alias("line"),
        F.concat(F.lit("m"), e % 5).alias("msg"), F.concat(F.lit("a"), e % 2).alias("adapter"), F.lit("form").alias("kind"),
    )


@query(f"WITH {FIND_SQL}, k AS (SELECT * FROM f WHERE ord % 4 = 0) SELECT ord FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.adapter = f.adapter AND k.kind = f.kind AND k.rule IS NOT DISTINCT FROM f.rule AND k.file = f.file AND k.line = f.line AND k.msg = f.msg)")
def new_adapter_findings(spark, d):
    f = findings(spark, d)
    return R.new_items(f, f.where("ord % 4 = 0"), R.ADAPTER_KEY).select("ord")


@query(f"WITH {FIND_SQL} SELECT DISTINCT rule, file, line, msg FROM f")
def unique_findings(spark, d):
    return R.unique_findings(findings(spark, d)).select(*R.FINDING)


@query(f"WITH {FIND_SQL} SELECT file, MIN(ord) AS ord, MAX_BY(msg, ord) AS msg FROM f GROUP BY file")
def last_findings(spark, d):
    return R.last_by_key(findings(spark, d).select("file", "ord", "msg"), ["file"])


@query("SELECT p_brand AS title FROM part EXCEPT ALL SELECT p_brand FROM part WHERE p_size > 20")
def removed_titles(spark, d):
    p = S.table(spark, d, "part")
    return R.multiset_minus(p.select(F.col("p_brand").alias("title")), p.where("p_size > 20").select("p_brand"))


@query("WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 6 <> 0) SELECT COALESCE(a.k, b.k) AS key, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def config_changes(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return R.config_changes(c.where("key % 5 <> 0"), c.where("key % 6 <> 0").withColumn("value", F.when(F.col("key") % 7 == 0, "X").otherwise(F.col("value"))))


@query("SELECT event_type AS notice, COUNT(*) AS n, MIN(event_id) AS ord FROM events GROUP BY 1")
def grouped_notices(spark, d):
    return R.grouped_notices(S.table(spark, d, "events").select(F.col("event_type").alias("notice"), F.col("event_id").alias("ord")))


@query("WITH r AS (SELECT event_type AS name, event_id AS ord, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) SELECT name, ord FROM r WHERE n <= 15 ORDER BY name, ord LIMIT 40")
def first_findings_per_check(spark, d):
    return R.first_per_check(S.table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("ord")))


RULES = "tamper/test-skipped tamper/no-tests-ran secret/token secret/machine-path secret/gitleaks crap dup/jscpd".split()
RULES_SQL = "r AS (SELECT event_id AS ord, list_value(" + ", ".join(f"'{x}'" for x in RULES) + ")[event_id % 7 + 1] AS rule FROM events)"


def ruled(spark, d):
    return S.table(spark, d, "events").select(F.col("event_id").alias("ord"), F.get(F.array(*map(F.lit, RULES)), (F.col("event_id") % 7).cast("int")).alias("rule"))


@query(f"WITH {RULES_SQL} SELECT ord, rule, CASE WHEN rule LIKE 'tamper/%' THEN 'tamper' ELSE 'secret' END AS flag FROM r WHERE rule IN ('tamper/test-skipped', 'secret/token', 'secret/gitleaks')")
def red_flags(spark, d):
    return R.red_flags(ruled(spark, d))


@query(f"WITH {RULES_SQL} SELECT COUNT(*) + (SELECT COUNT(*) FROM nation WHERE n_regionkey = 1) AS fails FROM r")
def fail_count(spark, d):
    checks = S.table(spark, d, "nation").select(F.when(F.col("n_regionkey") == 1, "x").alias("error"))
    return R.fail_count(ruled(spark, d), checks)


@query("SELECT file FROM (SELECT 'o' || l_orderkey AS file FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT 'o' || l_orderkey FROM lineitem WHERE l_linestatus = 'O') ORDER BY file LIMIT 10")
def partly_staged(spark, d):
    line = S.table(spark, d, "lineitem").withColumn("file", S.order_file("l_orderkey"))
    return R.intersect_first(line.where("l_returnflag = 'R'"), line.where("l_linestatus = 'O'"))


@query("WITH p AS (SELECT 'o' || o_orderkey AS file, 'a' AS tool FROM orders WHERE o_orderkey % 3 > 0), b AS (SELECT 'o' || o_orderkey AS file, 'b' AS tool FROM orders) SELECT * FROM p UNION ALL SELECT * FROM b WHERE file NOT IN (SELECT file FROM p)")
def fallback_analyser(spark, d):
    o = S.table(spark, d, "orders").withColumn("file", S.order_file())
    return R.primary_or_fallback(o.where("o_orderkey % 3 > 0").select("file", F.lit("a").alias("tool")), o.select("file", F.lit("b").alias("tool")))


EDGES_SQL = "n AS (SELECT COUNT(*) AS n FROM customer), e AS (SELECT c_custkey AS src, (c_custkey * 7 + 3) % n AS dst FROM customer, n)"


def edges(spark, d):
    c = S.table(spark, d, "customer")
    return c.join(c.agg(F.count("*").alias("n"))).select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % F.col("n")).alias("dst"))


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 50 = 1 UNION SELECT src FROM e JOIN r ON e.dst = r.node) SELECT node FROM r")
def reaching_tests(spark, d):
    start = S.table(spark, d, "customer").where("c_custkey % 50 = 1").select(F.col("c_custkey").alias("node"))
    return G.reaching(edges(spark, d), start).select("node")


@query("WITH c AS (SELECT 'o' || o_custkey AS file, MIN(1 + o_orderkey % 3) AS priority FROM orders GROUP BY 1) SELECT file, priority FROM c ORDER BY priority, file LIMIT 40")
def selected_tests(spark, d):
    return G.select_tests(S.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_custkey")).alias("file"), (1 + F.col("o_orderkey") % 3).alias("priority")), 40)


@query("SELECT GREATEST(COUNT(DISTINCT o_custkey) - 40, 0) AS omitted FROM orders")
def omitted_tests(spark, d):
    return G.omitted_tests(S.table(spark, d, "orders").select(F.col("o_custkey").alias("file")), 40)


NAMES = ["src/a{}.ts", "src/a{}.test.ts", "lib/x{}.py", "lib/test_x{}.py", "pkg/y{}.go", "pkg/y{}_test.go", "doc/z{}.md", "w{}/src/test/Q.java"]
NAMES_SQL = "f AS (SELECT o_orderkey AS ord, replace(list_value(" + ", ".join(f"'{x}'" for x in NAMES) + ")[o_orderkey % 8 + 1], '{}', CAST(o_orderkey // 16 AS VARCHAR)) AS file FROM orders)"


def files(spark, d):
    n = F.col("o_orderkey")
    return S.table(spark, d, "orders").select(n.alias("ord"), F.replace(F.get(F.array(*map(F.lit, NAMES)), (n % 8).cast("int")), F.lit("{}"), F.floor(n / 16).cast("string")).alias("file"))


@query(f"WITH {NAMES_SQL} SELECT ord, CASE ord % 8 WHEN 0 THEN 'ts' WHEN 1 THEN 'ts' WHEN 2 THEN 'py' WHEN 3 THEN 'py' WHEN 4 THEN 'go' WHEN 5 THEN 'go' WHEN 7 THEN 'java' END AS language, ord % 8 IN (1, 3, 5, 7) AS test, ord % 8 = 0 AS source FROM f")
def file_kinds(spark, d):
    f = files(spark, d)
    return f.select("ord", T.language_of(F.col("file")).alias("language"), T.is_test_file(F.col("file")).alias("test"), T.is_project_source(F.col("file"), ["src"]).alias("source"))


@query(f"WITH {NAMES_SQL}, u AS (SELECT DISTINCT file FROM f), n AS (SELECT DISTINCT file AS source, CASE WHEN ord % 8 = 0 THEN replace(file, '.ts', '.test.ts') WHEN ord % 8 = 2 THEN replace(file, 'lib/x', 'lib/test_x') ELSE replace(file, '.go', '_test.go') END AS file FROM f WHERE ord % 8 IN (0, 2, 4)) SELECT source, file FROM n JOIN u USING (file)")
def named_tests(spark, d):
    f = files(spark, d)
    return G.named_tests(f.where("ord % 8 in (0, 2, 4)").select("file").distinct(), f)


@query(f"WITH {NAMES_SQL}, u AS (SELECT DISTINCT file FROM f) SELECT file, CASE WHEN file LIKE 'src/%' THEN 'src' ELSE '.' END AS root FROM u WHERE file LIKE '%.ts' OR file LIKE '%.py'")
def deepest_roots(spark, d):
    roots = spark.createDataFrame([(".", [".ts", ".py"]), ("src", [".ts"]), ("lib", [".go"])], "root string, extensions array<string>")
    return G.deepest_root(files(spark, d).select("file").distinct(), roots)


@query(f"WITH {EDGES_SQL} SELECT 'm' || src % 10 || '/' || src AS src, 'm' || dst % 10 || '/' || dst AS dst, 'one-two' AS rule FROM e WHERE src % 10 = 1 AND dst % 10 IN (0, 2)")
def layer_violations(spark, d):
    e = edges(spark, d).select(*(F.concat(F.lit("m"), F.col(c) % 10, F.lit("/"), F.col(c)).alias(c) for c in ("src", "dst")))
    rules = spark.createDataFrame([("one-two", "^m1/", "^m[02]/")], "rule string, source string, target string")
    return G.layer_violations(e, rules)


@query(
    """SELECT 'src/f' || o_orderkey || '.ts' AS file, CASE o_orderkey % 4 WHEN 0 THEN './m' WHEN 1 THEN '../lib/m' WHEN 2 THEN '@/m' END || o_orderkey AS specifier,
    CASE o_orderkey % 4 WHEN 0 THEN 'src/m' || o_orderkey || '.ts' WHEN 1 THEN 'lib/m' || o_orderkey || '/index.ts' WHEN 2 THEN 'app/m' || o_orderkey || '.tsx' END AS target FROM orders WHERE o_orderkey % 4 < 3"""
)
def resolved_imports(spark, d):
    n, k = F.col("o_orderkey"), F.col("o_orderkey") % 4
    line = F.when(k == 0, F.concat(F.lit('import { a } from "./m'), n, F.lit('";'))).when(k == 1, F.concat(F.lit('const x = require("../lib/m'), n, F.lit('");'))).when(k == 2, F.concat(F.lit('export * from "@/m'), n, F.lit('";'))).otherwise('import "react";')
    o = S.table(spark, d, "orders")
    names = o.select(F.explode(F.array(F.concat(F.lit("src/m"), n, F.lit(".ts")), F.concat(F.lit("lib/m"), n, F.lit("/index.ts")), F.concat(F.lit("app/m"), n, F.lit(".tsx")))).alias("file"))
    configs = spark.createDataFrame([("tsconfig.json", '{"compilerOptions": {"paths": {"@*": ["other/*"], "@/*": ["app/*"]}}}')], "file string, text string")
    lines = o.select(F.concat(F.lit("src/f"), n, F.lit(".ts")).alias("file"), line.alias("text"))
    return G.module_targets(G.import_specifiers(lines), names, configs, configs.limit(0))
