"""Queries over checks, baselines, pushes, settings and reports of external analysers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions.ordering import dealt
from gristmill.operators import clones as C
from gristmill.operators import gate as G
from gristmill.operators import ingest as I
from gristmill.operators import supply as Y
from gristmill.plans import standins as S
from gristmill.plans.cases import Book, mixed, mixed_sql, pick, pick_sql

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


def none():
    return F.lit(None).cast("string")


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Checks


@BOOK.query(
    "SELECT 'a' AS name, 0 AS ord, event_type AS rule, 'u' || user_id AS file, event_id::INTEGER AS line, 'm' AS msg FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'b', 1, event_type, 'u' || user_id, event_id::INTEGER, 'm' FROM events WHERE event_id % 3 = 1"
)
def all_checks(spark, d):
    e = S.table(spark, d, "events").select("event_id", F.col("event_type").alias("rule"), text("u", F.col("user_id")).alias("file"), F.col("event_id").alias("line"), F.lit("m").alias("msg"))
    return G.all_checks({"a": e.where("event_id % 3 = 0"), "b": e.where("event_id % 3 = 1")})


DOCS = ["docs/a.md", "conf/b.TOML", "src/c.md", "src/d.ts", "e.yml", "f.json", "srcs/g.yaml"]


@BOOK.query(
    f"""WITH {mixed_sql(k=len(DOCS))}, g AS (SELECT id % 100 AS g, bool_and(k NOT IN (2, 3)) AS plain FROM c WHERE (id // 100) % 2 = 0 GROUP BY 1) SELECT COUNT(*) FILTER (plain) > 0 AS docs_only, 'some' AS scope FROM (SELECT bool_and(k NOT IN (2, 3)) AS plain FROM c WHERE k NOT IN (2, 3))
    UNION ALL SELECT bool_and(k NOT IN (2, 3)), 'mixed' FROM c UNION ALL SELECT FALSE, 'all' UNION ALL SELECT FALSE, 'none'"""
)
def docs_only(spark, d):
    rows = mixed(spark, d, k=len(DOCS)).select("k", pick(DOCS, "k").alias("file"))
    plain = rows.where("k not in (2, 3)")
    parts = {"some": G.docs_only(plain, ["src"]), "mixed": G.docs_only(rows, ["src"]), "all": G.docs_only(plain, ["src"], "all"), "none": G.docs_only(rows.limit(0), ["src"])}
    out = None
    for name, df in parts.items():
        df = df.withColumn("scope", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


@BOOK.query("SELECT 'infra/' || p_brand || '/x' || p_partkey || '.tf' AS file FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'src/auth' || p_partkey || '.ts' FROM part WHERE p_size % 3 = 1")
def escalations(spark, d):
    k = F.col("p_size") % 3
    file = F.when(k == 0, text("infra/", F.col("p_brand"), "/x", F.col("p_partkey"), ".tf")).when(k == 1, text("src/auth", F.col("p_partkey"), ".ts")).otherwise(text("src/b", F.col("p_partkey"), ".ts"))
    return G.escalations(S.table(spark, d, "part").select(file.alias("file")), ["infra/**/*.tf", "src/auth*.{ts,js}"])


@BOOK.query(f"WITH {S.SCORED_SQL}, {S.TOUCHED_SQL} SELECT ord FROM scored WHERE ord % 3 = 0 AND cc > 1 AND ord % 5 > 0")
def unchanged_drift(spark, d):
    from gristmill.operators import complexity as C

    scored = C.score(S.functions(spark, d), S.hits(spark, d)).withColumn("key", F.col("ord").cast("string"))
    base = scored.select("key", F.when((F.col("ord") % 3 == 0) & (F.col("cc") > 1), F.col("cc") - 1).otherwise(F.col("cc")).alias("cc"), F.col("crap"))
    return G.function_drift(scored, scored.where("ord % 5 = 0").select("key"), base).select("ord")


@BOOK.query(
    """SELECT 'deps' AS rule, '.' AS file, 0 AS line, 'new import cycle: ' || MIN(p_name) AS msg FROM part WHERE p_size % 4 > 0 GROUP BY p_brand, p_size HAVING p_size % 4 > 0 AND p_brand || '/' || p_size NOT IN (SELECT p_brand || '/' || p_size FROM part WHERE p_size % 8 = 1)
    UNION ALL SELECT DISTINCT 'deps', '.', 0, 'new layer violation: ' || p_type FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size = 3) UNION ALL SELECT 'deps', '.', 0, 'deps: baseline has no dependency lists, rerun with --update-baseline'"""
)
def dependency_findings(spark, d):
    p = S.table(spark, d, "part")
    key = F.concat_ws("/", "p_brand", "p_size").alias("key")
    cycles = p.where("p_size % 4 > 0").groupBy(key).agg(F.min("p_name").alias("text"))
    layers = p.select(F.col("p_type").alias("layer")).distinct()
    known_layers = p.where("p_size = 3").select(F.col("p_type").alias("layer"))
    judged = G.dependency_findings(cycles, layers, p.where("p_size % 8 = 1").select(key), known_layers)
    return judged.unionByName(G.dependency_findings(cycles, layers, None, None))


@BOOK.query(
    """SELECT 'new' AS state, 'new unused ' || CASE WHEN p_size % 2 = 0 THEN 'file' ELSE 'export' END || ' n' || p_partkey AS msg FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT 'new', 'new unused export n' || p_partkey FROM part WHERE p_partkey % 3 > 0 AND p_size % 2 = 1
    UNION ALL SELECT 'no-list', 'baseline has no knip list; --update-baseline to gate dead code' UNION ALL SELECT 'error', 'it broke'"""
)
def dead_code_states(spark, d):
    items = S.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "file").otherwise("export").alias("kind"), text("n", F.col("p_partkey")).alias("name"))
    known = items.where("p_partkey % 3 = 0").select("kind", "name")
    now = items.select("kind", "name")
    parts = [G.dead_code_check(now, known, none()), G.dead_code_check(now, known, none(), with_files=False), G.dead_code_check(now, None, none()), G.dead_code_check(now, known, F.lit("it broke"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@BOOK.query("SELECT 'debt' AS of, COUNT(*) AS new FROM nation WHERE n_regionkey > 0 UNION ALL SELECT 'baseline', COUNT(*) FROM nation WHERE n_regionkey > 1 UNION ALL SELECT 'neither', 0")
def debt_as_baseline(spark, d):
    from gristmill.operators import ratchet as R

    n = S.table(spark, d, "nation")
    base, debt = n.where("n_regionkey <= 1"), n.where("n_regionkey = 0")
    out = None
    for name, b, t in (("debt", None, debt), ("baseline", base, debt), ("neither", None, None)):
        row = R.new_items(n, G.baseline_or_debt(b, t), ["n_nationkey"]).agg(F.count("*").alias("new")).select(F.lit(name).alias("of"), "new")
        out = row if out is None else out.unionByName(row)
    return out


@BOOK.query("SELECT 'all' AS scope, p_partkey FROM part UNION ALL SELECT 'change', p_partkey FROM part WHERE p_size % 3 > 0")
def audit_ratchet(spark, d):
    rows = S.table(spark, d, "part").select("p_partkey", "p_size", F.lit("osv").alias("adapter"), F.lit("audit").alias("kind"), F.lit("deps/audit").alias("rule"), F.col("p_brand").alias("file"), F.lit(0).alias("line"), text(F.col("p_partkey")).alias("msg"))
    known = rows.where("p_size % 3 = 0")
    return G.audit_findings(rows, known, "all").select(F.lit("all").alias("scope"), "p_partkey").unionByName(G.audit_findings(rows, known).select(F.lit("change").alias("scope"), "p_partkey"))


@BOOK.query("SELECT 'r' || user_id % 7 AS root, event_type AS kind, 'c' || event_id % 5 AS command, MIN(event_id) AS n FROM events GROUP BY ALL")
def tool_runs(spark, d):
    e = F.col("event_id")
    rows = S.table(spark, d, "events").select(text("r", F.col("user_id") % 7).alias("root"), F.col("event_type").alias("kind"), text("c", e % 5).alias("command"), e.alias("ord"), e.alias("n"))
    return G.tool_runs(rows).select("root", "kind", "command", "n")


@BOOK.query(
    """SELECT 'known' AS of, 'deps/audit: ' || COUNT(DISTINCT p_brand) || ' finding(s) (' || SUM(p_size) || ' packages, osv-scanner)' AS notice FROM part UNION ALL SELECT 'unknown', 'deps/audit: ' || COUNT(DISTINCT p_brand) || ' finding(s) (package count unavailable, osv-scanner)' FROM part
    UNION ALL SELECT 'none', 'not run: deps/audit (osv-scanner: no packages found)'"""
)
def audit_summaries(spark, d):
    p = S.table(spark, d, "part")
    found = p.select(F.lit("deps/audit").alias("rule"), F.lit("uv.lock").alias("file"), F.lit(0).alias("line"), F.col("p_brand").alias("msg"))
    scans = p.select(F.col("p_name").alias("file"), F.col("p_size").alias("packages"))
    some = scans.withColumn("packages", F.when(F.col("packages") > 1, F.col("packages")))
    out = G.audit_summary(scans, found).withColumn("of", F.lit("known")).unionByName(G.audit_summary(some, found).withColumn("of", F.lit("unknown")))
    return out.unionByName(G.audit_summary(scans.limit(0), found).withColumn("of", F.lit("none")))


@BOOK.query("WITH f AS (SELECT DISTINCT p_brand AS file, p_size AS line FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_brand, p_size FROM part WHERE p_partkey % 3 = 0 AND p_brand LIKE '%1') SELECT 'form/gocyclo' AS rule, file, line, 'm' AS msg FROM f")
def recovered_findings(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", F.lit("form/gocyclo").alias("rule"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.lit("m").alias("msg"))
    cut = ["rule", "file", "line", "msg"]
    return G.recovered(p.where("p_partkey % 2 = 0").select(*cut), p.where("p_partkey % 3 = 0").select(*cut), p.where("file like '%1'").select("file"))


@BOOK.query(
    f"""WITH {mixed_sql(s=2, t=2, m=3)} SELECT s, t, m, CASE WHEN m = 2 THEN 'note' ELSE 'finding' END AS kind, CASE WHEN m = 2 THEN 'note: bypass tamper/no-tests-ran (commit-msg): only a comment' ELSE 'source changed, no test touched or found; add/refer a test or qg:no-test <reason>' END AS msg
    FROM (SELECT DISTINCT s, t, m FROM c) WHERE s = 1 AND t = 0"""
)
def no_test_checks(spark, d):
    rows = mixed(spark, d, s=2, t=2, m=3)
    out = None
    for s in (0, 1):
        for t in (0, 1):
            for m in (0, 1, 2):
                mine = rows.where(f"s = {s} and t = {t} and m = {m}")
                files = mine.select(text("src/a" if s else "docs/a", F.col("id"), ".ts").alias("file"))
                tests = mine.where(F.lit(bool(t))).select(text("src/a", F.col("id"), ".test.ts").alias("file"))
                said = mine.select(F.col("id").alias("ord"), F.lit(["fix", "fix qg:no-test", "fix\n\nqg:no-test only a comment "][m]).alias("text"))
                one = G.no_test_check(files, tests, said, ["src"]).withColumns({"s": F.lit(s), "t": F.lit(t), "m": F.lit(m)})
                out = one if out is None else out.unionByName(one)
    return out


# Lines


@BOOK.query(
    f"""WITH {mixed_sql(scope=2, skipped=2, invalid=2, used=2, removed=2, failed=3)}, r AS (SELECT *, 'exit ' || id % 4 || ', failed ' || CASE failed WHEN 0 THEN 'unknown' ELSE failed::VARCHAR END AS run FROM c)
    SELECT id, CASE WHEN scope = 0 THEN 'tests: touched run ' || run || ', lcov ' || CASE WHEN used = 0 THEN 'none' WHEN removed = 1 THEN 'l.info (removed after the verdict)' ELSE 'l.info' END WHEN skipped = 1 AND id % 5 > 0 THEN 'tests: not run (last full run 2026, abcdef12)'
    WHEN invalid = 1 THEN 'tests ' || run || ', invalid coverage (CRAP and mean not judged; complexity only)' WHEN used = 0 THEN 'tests: not run, no fresh lcov (CRAP and mean not judged; complexity only)' ELSE 'tests ' || run END AS line,
    CASE WHEN failed = 0 THEN 'exit ' || id % 4 || ', failed count not found in tests.log' ELSE failed || ' failed' END AS red FROM r"""
)
def tests_lines(spark, d):
    rows = mixed(spark, d, scope=2, skipped=2, invalid=2, used=2, removed=2, failed=3)
    failed, code = F.when(F.col("failed") > 0, F.col("failed")), F.col("id") % 4
    last = F.when(F.col("id") % 5 > 0, F.struct(F.lit("2026").alias("written"), F.lit("abcdef123456").alias("commit")))
    line = G.tests_line(pick(["touched", "full"], "scope"), F.col("skipped") == 1, F.col("invalid") == 1, F.col("used") == 1, F.col("removed") == 1, code, failed, F.lit("l.info"), last)
    return rows.select("id", line.alias("line"), G.red_text(failed, code).alias("red"))


@BOOK.query(
    """SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN 'no data' ELSE floor(l_discount * 100 + 0.5)::INTEGER || '%' END AS percent, 'cov/diff: ' || printf('%.1f', CASE WHEN l_linenumber = 1 THEN 100.0 ELSE (l_linenumber // 2) * 100.0 / (l_linenumber - l_linenumber % 2) END) || '% (' ||
    CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber // 2 END || '/' || (l_linenumber - l_linenumber % 2) || ' executable added lines, minimum 80%)' AS line FROM lineitem"""
)
def coverage_lines(spark, d):
    n = F.col("l_linenumber")
    total = n - n % 2
    shown = G.coverage_line(F.floor(n / 2).cast("int"), total, F.lit(0.8))
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), G.percent(F.when(n < 7, F.col("l_discount"))).alias("percent"), shown.alias("line"))


@BOOK.query(
    f"""WITH {mixed_sql(out=4, bad=4, code=2, ran=2, failed=3)} SELECT id, CASE WHEN out = 0 THEN 'timed out after 60s' WHEN bad = 0 THEN 'cannot be read: no counts' WHEN code > 0 OR failed > 0 THEN 'fail on the original bytes (exit ' || code || ', ' || failed || ' failed)' WHEN ran = 0 THEN 'no test ran' END AS problem FROM c"""
)
def preflight_problems(spark, d):
    rows = mixed(spark, d, out=4, bad=4, code=2, ran=2, failed=3)
    error = F.when(F.col("bad") == 0, "no counts")
    return rows.select("id", G.preflight_problem(F.col("out") == 0, F.lit(60), error, F.col("code"), F.col("ran"), F.col("failed")).alias("problem"))


# Pushes


@BOOK.query("SELECT user_id AS sha, MIN((event_id % 4) * 1000000000 + event_id) AS at FROM events GROUP BY 1")
def pushed_commits(spark, d):
    rows = S.table(spark, d, "events").select(F.col("user_id").alias("sha"), (F.col("event_id") % 4).alias("range_ord"), F.col("event_id").alias("ord"))
    return G.pushed_commits(rows).select("sha", (F.col("ord.range_ord") * 1000000000 + F.col("ord.ord")).alias("at"))


@BOOK.query("SELECT event_type AS rule, 'u' || user_id AS file, event_id % 3 AS line, 'm' AS msg, MIN(event_id) AS ord FROM events GROUP BY ALL")
def pushed_findings(spark, d):
    return G.pushed_findings(S.table(spark, d, "events").select(F.col("event_type").alias("rule"), text("u", F.col("user_id")).alias("file"), (F.col("event_id") % 3).alias("line"), F.lit("m").alias("msg"), F.col("event_id").alias("ord")))


@BOOK.query(
    """WITH p AS (SELECT o_orderkey AS ord, 'f' || o_custkey AS file FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT DISTINCT 'f' || c_custkey AS file FROM customer WHERE c_custkey % 5 = 0 AND ('f' || c_custkey IN (SELECT file FROM p) OR c_custkey % 10 = 5)),
    s AS (SELECT string_agg(file, ', ' ORDER BY file) AS names FROM (SELECT file FROM n ORDER BY file LIMIT 10)) SELECT 'dirty' AS of, 'touched tests not run: uncommitted changes in files they read: ' || names AS problem FROM s
    UNION ALL SELECT 'other', 'touched tests not run: pushing bbbbbbb (refs/' || MIN(o_orderkey) || '), this checkout is at aaaaaaa' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 UNION ALL SELECT 'clean', NULL"""
)
def tree_problems(spark, d):
    o = S.table(spark, d, "orders").where("o_orderkey % 2 = 0")
    head = "a" * 40
    pushed = o.select(F.col("o_orderkey").alias("ord"), text("refs/", F.col("o_orderkey")).alias("ref"), F.lit(head).alias("commit"), text("f", F.col("o_custkey")).alias("file"))
    moved = pushed.withColumn("commit", F.when(F.col("ord") % 3 == 0, "b" * 40).otherwise(F.col("commit")))
    c = S.table(spark, d, "customer").withColumn("file", text("f", F.col("c_custkey")))
    tests, dirty = c.where("c_custkey % 10 = 5").select("file"), c.where("c_custkey % 5 = 0").select("file")
    parts = {"dirty": G.tree_problem(pushed, tests, dirty, head), "other": G.tree_problem(moved, tests, dirty, head), "clean": G.tree_problem(pushed, tests, dirty.limit(0), head)}
    out = None
    for name, df in parts.items():
        df = df.withColumn("of", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


# Reports and settings


@BOOK.query("WITH r AS (SELECT p_brand AS kind, p_partkey AS ord, p_name AS name FROM part), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY ord) AS i FROM r) SELECT kind, COUNT(*) AS n, string_agg(name, '|' ORDER BY ord) FILTER (i <= 3) AS shown FROM k GROUP BY kind")
def list_heads(spark, d):
    rows = S.table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return G.list_heads(rows, 3).select("kind", "n", F.array_join("shown", "|").alias("shown"))


@BOOK.query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'Changed functions' ELSE 'Drift|Summary|Worklist|Hotspots|Top 30 CRAP' END AS shown, CASE WHEN event_id % 2 = 0 THEN 'Drift|Summary|Worklist|Hotspots|Top 30 CRAP' ELSE '' END AS absent FROM events")
def report_sections(spark, d):
    titles = lambda shown: F.array_join(F.transform(F.filter("s", lambda x: x["shown"] == shown), lambda x: x["title"]), "|")
    scope = F.when(F.col("event_id") % 2 == 0, "touched").otherwise("full")
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), G.report_sections(scope).alias("s")).select("id", titles(True).alias("shown"), titles(False).alias("absent"))


@BOOK.query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9:+.-]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part UNION ALL SELECT 0, 'machete'")
def tool_slugs(spark, d):
    named = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return named.unionByName(spark.createDataFrame([(0, "Cargo machete ")], "id long, name string")).select("id", G.slug(F.col("name")).alias("slug"))


@BOOK.query(
    """SELECT 't' || p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN '@x/t' || p_partkey || '@9.' || p_size WHEN p_size % 2 = 0 THEN 't' || p_partkey || '==1.0' ELSE '@x/t' || p_partkey || '@1.0' END AS spec,
    CASE WHEN p_size % 4 = 2 THEN '/opt/t' || p_size WHEN p_size % 3 = 0 THEN 'bin' ELSE 't' || p_partkey END AS binary FROM part"""
)
def tool_overrides(spark, d):
    p, k = S.table(spark, d, "part"), F.col("p_size")
    even = k % 2 == 0
    name = text("t", F.col("p_partkey"))
    tools = p.select(name.alias("id"), F.when(even, text(name, "==1.0")).otherwise(text("@x/", name, "@1.0")).alias("spec"), F.when(even, "==").otherwise("@").alias("separator"), F.when(k % 3 == 0, "bin").alias("binary"))
    value = F.when(k % 4 == 1, text(" 9.", k)).when(k % 4 == 2, text("/opt/t", k)).otherwise("  ")
    return G.tool_specs(tools, p.select(name.alias("id"), value.alias("value")))


@BOOK.query(
    """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'https://npm/@x/n' || p_partkey || '/1.0%2B1' WHEN 1 THEN 'https://mirror/g/a%20' || p_partkey || '.json' END AS url FROM part"""
)
def registry_urls(spark, d):
    p, k = S.table(spark, d, "part"), F.col("p_size") % 4
    package = p.select("p_partkey", F.when(k == 0, "npm").when(k == 1, "maven").when(k == 2, "off").otherwise("other").alias("registry"), F.when(k == 1, text("g:a ", F.col("p_partkey"))).otherwise(text("@x/n", F.col("p_partkey"))).alias("name"), F.lit("1.0+1").alias("version"))
    known = spark.createDataFrame([("npm", "https://npm/{name}/{version}"), ("maven", "https://maven/{name}"), ("off", "https://off/{name}")], "registry string, url string")
    mine = spark.createDataFrame([("maven", " https://mirror/{group}/{artifact}.json "), ("off", " ")], "registry string, url string")
    found = G.registry_urls(package.select("registry", "name", "version"), known, mine)
    return found.select(F.regexp_extract("name", r"([0-9]+)\z", 1).cast("long").alias("id"), F.replace("url", F.lit("%40"), F.lit("@")).alias("url"))


PROVIDERS = ["auto", "first", "second", "custom", "mine"]


@BOOK.query(
    f"""WITH {mixed_sql(p=len(PROVIDERS), u=2, k=3, m=2)}, r AS (SELECT *, CASE WHEN p IN (0, 2) THEN 'second' WHEN p = 1 THEN 'first' ELSE {pick_sql(PROVIDERS, 'p')} END AS provider, CASE k WHEN 1 THEN 'OPEN_KEY' WHEN 2 THEN 'NO_KEY' WHEN 0 THEN CASE WHEN p IN (0, 2) THEN 'OPEN_KEY' WHEN p = 1 THEN 'SAFE_KEY' END END AS key_env FROM c)
    SELECT id, provider, key_env, CASE WHEN p = 4 THEN 'unknown review.provider mine' WHEN p = 3 AND (u = 0 OR k = 0 OR m = 0) THEN 'review.provider = custom needs ' || concat_ws(', ', CASE WHEN u = 0 THEN 'review.url' END, CASE WHEN k = 0 THEN 'review.key_env' END, CASE WHEN m = 0 THEN 'review.model' END)
    WHEN key_env <> 'OPEN_KEY' THEN key_env || ' is not set' END AS problem FROM r"""
)
def classifier_targets(spark, d):
    rows = mixed(spark, d, p=len(PROVIDERS), u=2, k=3, m=2)
    review = rows.select("id", F.when(F.col("id") % 2 == 0, pick(PROVIDERS, "p")).otherwise(F.nullif(pick(PROVIDERS, "p"), F.lit("auto"))).alias("provider"), pick(["", "https://x"], "u").alias("url"), pick([" ", "OPEN_KEY", "NO_KEY"], "k").alias("key_env"), pick(["", "m"], "m").alias("model"))
    known = spark.createDataFrame([("first", 0, "https://t", "SAFE_KEY", "t1"), ("second", 1, "https://o", "OPEN_KEY", "o1")], "provider string, ord int, url string, key_env string, model string")
    return G.classifier_target(review, known, spark.createDataFrame([("OPEN_KEY",)], "key_env string")).select("id", "provider", "key_env", "problem")


# External analysers


@BOOK.query(
    f"""WITH {S.TOUCHED_SQL}, k AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS f, 'o' || o_custkey AS g, o_orderkey % 5 AS s FROM orders), a AS (SELECT DISTINCT ord FROM k JOIN touched t ON t.file = k.f AND t.line BETWEEN s AND s + 2), b AS (SELECT DISTINCT ord FROM k JOIN touched t ON t.file = k.g AND t.line BETWEEN 3 AND 6)
    SELECT 'dup/jscpd' AS rule, CASE WHEN ord IN (SELECT ord FROM a) THEN f ELSE g END AS file, CASE WHEN ord IN (SELECT ord FROM a) THEN s ELSE 3 END AS line, CASE WHEN ord IN (SELECT ord FROM a) THEN '12 duplicated lines with ' || g || ':3-6' ELSE '12 duplicated lines with ' || f || ':' || s || '-' || s + 2 END AS msg
    FROM k WHERE ord IN (SELECT ord FROM a) OR ord IN (SELECT ord FROM b)"""
)
def clone_findings(spark, d):
    s = F.col("o_orderkey") % 5
    side = lambda file, start, end: F.struct(file.alias("file"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    clones = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.lit(12).alias("lines"), side(S.order_file(), s, s + 2).alias("a"), side(S.order_file("o_custkey"), F.lit(3), F.lit(6)).alias("b"))
    return I.clone_findings(clones, S.touched(spark, d))


#: Tokens and lines as the operator cuts them, then a table of all windows.
CLONES_SQL = r"""WITH t AS (SELECT doc_id, UNNEST(k) AS tok, UNNEST(range(len(k))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x0B\x1C-\x1F\x{85}]|\n') AS k FROM (SELECT DISTINCT doc_id, text FROM documents))),
l AS (SELECT *, 1 + SUM((tok = chr(10))::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM t), w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE tok <> chr(10)),
h AS (SELECT doc_id, pos, line, LEAD(line, 69) OVER (PARTITION BY doc_id ORDER BY pos) AS last, md5(string_agg(tok, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 69 FOLLOWING)) AS h FROM w),
f AS (SELECT *, FIRST_VALUE({'d': doc_id, 'p': pos, 'a': line, 'b': last}) OVER (PARTITION BY h ORDER BY doc_id, pos) AS f FROM h WHERE last IS NOT NULL),
r AS (SELECT *, pos - ROW_NUMBER() OVER (PARTITION BY doc_id, f.d, pos - f.p ORDER BY pos) AS run FROM f WHERE doc_id <> f.d OR pos - f.p >= 70)
SELECT doc_id AS file, MIN(line)::INTEGER AS start, MAX(last)::INTEGER AS "end", f.d AS first_file, MIN(f.a)::INTEGER AS first_start, MAX(f.b)::INTEGER AS first_end, (MAX(last) - MIN(line) + 1)::INTEGER AS lines, (COUNT(*) + 69)::INTEGER AS tokens FROM r GROUP BY doc_id, f.d, pos - f.p, run"""


@BOOK.query(CLONES_SQL)
def found_clones(spark, d):
    clones = C.found_clones(S.table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text"))
    return clones.select("b.file", "b.start", "b.end", F.col("a.file").alias("first_file"), F.col("a.start").alias("first_start"), F.col("a.end").alias("first_end"), "lines", "tokens")


RULES = ["empty-catch", "catch-only-logs", "textual-test", "other"]
FILES = ["a.ts", "b.go", "c.rs", "d.py", "e.md"]


@BOOK.query(f"WITH {mixed_sql(r=4, f=5, t=3)} SELECT 'ast/' || {pick_sql(RULES, 'r')} AS rule, id AS line FROM c WHERE t < 2 AND f < 4 AND (r = 2 OR (r < 2 AND f IN (0, 3)))")
def structural_findings(spark, d):
    rows = mixed(spark, d, r=4, f=5, t=3)
    file = text("d", F.col("id"), "/", pick(FILES, "f"))
    matches = rows.select(pick(RULES, "r").alias("rule"), file.alias("file"), F.col("id").alias("start"), (F.col("id") + 2).alias("end"), F.lit("m").alias("msg"))
    touched = rows.select(file.alias("file"), (F.col("id") + pick([0, 2, 3], "t")).alias("line"))
    return I.structural_findings(matches, touched).select("rule", "line")


EVALS = ["eval (x)", "exec(y)", "evaluate(z)", "my_eval(q)", "x.exec (a)", "retrieval(b)"]


@BOOK.query(f"WITH {mixed_sql(k=len(EVALS))} SELECT 'note: security/semgrep dynamic-eval f:' || id || ' Dynamic eval or exec requires a security review' AS note FROM c WHERE k IN (0, 1, 4)")
def security_notes(spark, d):
    return I.security_notes(mixed(spark, d, k=len(EVALS)).select(F.lit("f").alias("file"), F.col("id").alias("line"), pick(EVALS, "k").alias("text")))


@BOOK.query(
    f"""WITH {S.TOUCHED_SQL}, m AS (SELECT DISTINCT 'o' || l_orderkey AS file, l_linenumber AS line FROM lineitem), w AS (SELECT file, line, CASE WHEN line BETWEEN 3 AND 4 THEN 3 WHEN line <= 5 THEN 1 ELSE line END AS a, CASE WHEN line BETWEEN 3 AND 4 THEN 4 WHEN line <= 5 THEN 5 ELSE line END AS b FROM m)
    SELECT 'form/max-depth' AS rule, file, line, 'deep' AS msg FROM w WHERE EXISTS (SELECT 1 FROM touched t WHERE t.file = w.file AND t.line BETWEEN a AND b)"""
)
def form_findings(spark, d):
    table = S.table(spark, d, "lineitem")
    lines = dealt(table.select(S.order_file("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")), table.count(), "file").distinct()
    messages = lines.select(F.explode(F.array(F.lit("max-depth"), F.lit("no-console"))).alias("rule"), "file", "line", F.lit("deep").alias("msg"))
    ranges = lines.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(1).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(4).alias("end")))).alias("r"))
    return I.form_findings(messages, ranges.select("file", "r.start", "r.end"), S.touched(spark, d))


@BOOK.query(
    """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 3 > 0 THEN 'native' ELSE 'general' END AS analyser FROM orders WHERE o_orderkey % 4 < 3"""
)
def functions_by_language(spark, d):
    k = F.col("o_orderkey")
    file = text("o", k, F.get(F.array(*map(F.lit, [".ts", ".py", ".go", ".txt"])), (k % 4).cast("int")))
    rows = S.table(spark, d, "orders").select(k.alias("ord"), file.alias("file"))
    found = rows.withColumn("analyser", F.lit("general")).unionByName(rows.where("ord % 3 > 0").withColumn("analyser", F.lit("native")))
    roots = rows.select("file", F.when(F.col("ord") % 4 < 3, ".").alias("root"))
    return I.functions_by_language(found, roots, ["ts", "py"]).select("ord", "analyser")


# Ages of lock records


@BOOK.query(
    """WITH r AS (SELECT o_orderkey AS ord, o_orderkey % 7 AS k FROM orders), s AS (SELECT MIN(ord) AS stop FROM r WHERE k = 6 AND ord > 20000), t AS (SELECT ord, CASE WHEN ord = stop THEN 'offline' WHEN ord > stop THEN 'skipped' WHEN k = 0 THEN 'young' WHEN k = 1 THEN 'old' WHEN k = 2 THEN 'bad-date' WHEN k = 3 THEN 'no-registry' WHEN k = 4 THEN 'missing' WHEN k = 5 THEN 'young' ELSE 'old' END AS state FROM r LEFT JOIN s ON TRUE)
    SELECT state, COUNT(*) AS n FROM t GROUP BY 1"""
)
def lock_ages(spark, d):
    k = F.col("o_orderkey") % 7
    records = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.lit("uv.lock").alias("file"), F.lit(1).alias("line"), F.lit("pypi").alias("registry"), text("n", F.col("o_orderkey")).alias("name"), F.lit("1").alias("version"), k.alias("k"))
    keyed = records.withColumn("key", text("pypi:", F.col("name"), "@1"))
    dates = pick(["2026-01-02T00:00:00Z", "2025-01-01T00:00:00Z", "not a date", None, None, "2026-01-01T13:00:00Z", "2020-01-01T00:00:00Z"], "k")
    cached = keyed.where("k in (0, 1) or (k = 6 and ord <= 20000)").select("key", dates.alias("published"))
    asked = keyed.select("key", F.when(~F.col("k").isin(3, 4), dates).alias("published"), ((F.col("k") == 6) & (F.col("ord") > 20000)).alias("offline"), (F.col("k") == 3).alias("no_registry"))
    return Y.lock_ages(records.drop("k"), cached, asked, F.lit("2026-01-02T12:00:00Z")).groupBy("state").agg(F.count("*").alias("n"))


@BOOK.query("SELECT 'deps/lock-age: not checked (no registry for eco' || user_id % 4 || ')' AS notice FROM events WHERE event_id % 3 = 0 GROUP BY user_id % 4 UNION ALL SELECT 'deps/lock-age: not checked (offline)'")
def lock_age_notices(spark, d):
    rows = S.table(spark, d, "events").select(text("eco", F.col("user_id") % 4).alias("registry"), F.when(F.col("event_id") % 3 == 0, "no-registry").otherwise("old").alias("state"))
    off = rows.unionByName(spark.createDataFrame([("npm", "offline")], "registry string, state string"))
    return Y.lock_age_notices(rows).unionByName(Y.lock_age_notices(off))


@BOOK.query("SELECT TRUE AS fresh, 'same' AS of UNION ALL SELECT FALSE, 'less' UNION ALL SELECT FALSE, 'none'")
def fresh_coverage(spark, d):
    files = S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    stored = Y.fingerprint(files.repartition("file"))
    less = Y.fingerprint(files.where("doc_id > 3"))
    return Y.fresh(files, stored).withColumn("of", F.lit("same")).unionByName(Y.fresh(files, less).withColumn("of", F.lit("less"))).unionByName(Y.fresh(files, stored.limit(0)).withColumn("of", F.lit("none")))
