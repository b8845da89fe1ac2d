"""Parsers and detectors on small inputs with values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import ordering, paths, patterns
from gristmill.operators import complexity, graph, ratchet, review, tamper, text
from gristmill.sources import coverage, diffs, testlogs
from gristmill.streaming import sessions


def lines(spark, body: str, doc: int = 0):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(body.split("\n"))], "doc int, ord int, text string")


def test_covered_half_of_the_own_lines(spark):
    fn = spark.createDataFrame([(1, "a", "f", 2, 2, 5, [])], "ord int, file string, name string, cc int, start int, end int, nested array<struct<a:int,b:int>>")
    hits = coverage.parse_lcov(lines(spark, "SF:a\nDA:2,1\nDA:3,1\nDA:4,0\nend_of_record"))
    row = complexity.score(fn, hits).first()
    assert (row["cov"], row["crap"]) == (0.5, 2.5)


def test_lcov_that_is_not_whole(spark):
    good = "SF:a\nDA:1,2\nend_of_record"
    for body, want in ((good, True), ("SF:a\nDA:1,2", False), ("DA:1,2\nend_of_record", False), ("SF:a\nSF:b\nDA:1,1\nend_of_record", False), ("SF:a\nDA:1,x\nend_of_record", False), ("SF:a\nend_of_record", False), (good + "\nDA:1,2", False), (good + "x", False), (good + "\n" + good, True)):
        assert coverage.valid_lcov(lines(spark, body)).first()["valid"] is want, body


def test_repeated_coverage_doubles_hits_and_keeps_coverage(spark):
    body = "SF:a\nDA:1,2\nDA:2,0\nend_of_record"
    once, twice = (coverage.parse_lcov(lines(spark, b)).orderBy("line").collect() for b in (body, f"{body}\n{body}"))
    assert [2 * r["hits"] for r in once] == [r["hits"] for r in twice]


def test_summaries_of_four_runners(spark):
    logs = [
        ("node", "ℹ tests 2\nℹ fail 1\n", 2, 1), ("node", "# tests 3\n# fail 0", 3, 0), ("bun", " 2 pass\n 0 fail\nRan 2 tests across 1 file.", 2, 0), ("bun", " 0 fail\nRan 0 tests across 1 files", 0, 0),
        ("vitest", "\x1b[2m      Tests \x1b[22m 1 failed | 1 passed (2)", 2, 1), ("vitest", " Tests  no tests", 0, 0), ("py", "==== 1 failed, 1 passed in 0.03s ====", 2, 1), ("py", "no tests ran in 0.01s", 0, 0),
        ("py", "2 passed in 0.1s\n1 failed, 2 passed, 1 error in 0.2s", 6, 2),
    ]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(logs)], "i int, runner string, log string, want_ran int, want_failed int")
    for r in testlogs.parse_summaries(rows).collect():
        assert (r["ran"], r["failed"], r["error"]) == (r["want_ran"], r["want_failed"], None), r


def test_a_pure_removal_touches_both_sides_of_the_gap(spark):
    body = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -3,2 +2,0 @@\n-x\n-- y\n@@ -9 +7 @@\n-a\n++ b"
    changed = diffs.parse_diff(lines(spark, body))
    assert [(r["side"], r["line"], r["text"]) for r in changed.orderBy("ord").collect()] == [("-", 3, "x"), ("-", 4, "- y"), ("-", 9, "a"), ("+", 7, "+ b")]
    assert sorted(r["line"] for r in diffs.touched_lines(changed).collect()) == [2, 3, 7]


def test_credentials_and_redaction(spark):
    rows = spark.createDataFrame([("key AKIA" + "A" * 16 + " end",), ("password: 'hunter2hunter' /home/me2/x",), ("gh" + "p_" + "a" * 36,), ("quiet",)], "text string")
    got = [r[0] for r in rows.select(text.redact(F.col("text"))).collect()]
    assert got == ["key [REDACTED] end", "password:[REDACTED]' /[REDACTED]/x", "[REDACTED]", "quiet"]
    assert rows.where(text.any_of(F.col("text"), patterns.SECRETS)).count() == 2


def test_ratchet_of_a_list_against_itself_is_empty(spark):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "kind string, name string")
    assert ratchet.new_items(rows, rows, ["kind", "name"]).count() == 0
    assert ratchet.new_items(rows, None, ["kind", "name"]).count() == 0
    assert ratchet.new_items(rows, rows.limit(0), ["kind", "name"]).count() == 2


def test_globs():
    import re

    test = patterns.test_file_regex()
    for name, want in (("a.test.ts", True), ("x/y/a.spec.jsx", True), ("test_a.py", True), ("a/b_test.go", True), ("a.ts", False), ("q/src/test/k/A.java", True), ("atest_a.py", False)):
        assert bool(re.match(test.replace(r"\z", r"\Z"), name)) is want, name


def test_renamed_titles(spark):
    pairs = [("it('reads the options')", "it('reads new options')", False), ("it('reads')", "test('reads')", True), ("it('adds')", "it('drops')", True), ("it.skip('a b')", "it('a  b')", False)]
    rows = [("a.test.ts", i, i, side, 1, text) for i, (old, new, _) in enumerate(pairs) for side, text in (("-", old), ("+", new))]
    changed = spark.createDataFrame(rows, "file string, hunk_ord long, new_start int, side string, line int, text string")
    assert {r["hunk_ord"] for r in tamper.deleted_tests(changed).collect()} == {i for i, p in enumerate(pairs) if p[2]}


def test_arguments_nest():
    assert tamper.first_argument("expect(f(a, [b]), 2)", 0) == "f(a,[b])"
    assert tamper.first_argument("expect(a", 0) == ""
    assert tamper.comments("a = '#'\nb  # x\n'''\n# y\n'''\n# z", True) == [(2, "x"), (6, "z")]
    assert tamper.comments('s = "//"; // a\n/*\n * b\n c */ x\n$y = 1; // z', True)[-1] == (5, "z")
    assert tamper.comments('s = "//"; // a\n/*\n * b\n c */ x', False) == [(1, "a"), (3, "b")]
    assert tamper.comments("x = 'open // a\n// b", False) == []


SKIPS = [
    "git commit --no-verify -m fix", "git commit -n -m fix", "git push --no-verify origin main", "git -c core.hooksPath=/tmp/empty commit -m fix", "git -ccore.hooksPath=/tmp/empty push",
    "git config core.hooksPath /tmp/empty", "git config --unset core.hooksPath", "echo ok && git commit --no-verify -m fix", "FOO=1 git commit --no-verify -m fix", "git commit -nm fix", "git commit -anF message.txt",
    'git commit -m "a; b" --no-verify', "git -C /x commit -n", "git -c user.name=x commit -nm y", "git --git-dir .git commit -n", 'git commit -m "it\'s \\" x" --no-"verify"', "sudo -u x /usr/bin/git commit -n",
]
KEEPS = [
    "git commit -m '--no-verify'", "git commit -m 'git config core.hooksPath /tmp'", "git commit --message=--no-verify", "echo 'git commit -n'", "# git push --no-verify", "git commit -- -n", "git push origin -- --no-verify",
    "git status", "git commit -mn", "git commit -m -n", "git commit -can", "git commit -C -n", "git commit -F -n", "git push -n", "x git commit -n", "git log -n 3", "", "'",
]


def test_bypasses(spark):
    rows = spark.createDataFrame([*enumerate(SKIPS + KEEPS), (99, None)], "ord long, text string")
    assert {r["ord"] for r in review.hook_bypasses(rows).collect()} == set(range(len(SKIPS)))


def test_empty_tables_give_no_rows(spark):
    changed = spark.createDataFrame([], "file string, hunk_ord long, new_start int, side string, line int, text string")
    assert tamper.deleted_tests(changed).count() == 0
    assert tamper.assertion_findings(changed).count() == 0
    assert tamper.mocks_of_unchanged(changed, changed).count() == 0
    assert tamper.marker_changes(changed).count() == 0


def test_sums_before_are_running_totals(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = {r["k"]: r["before"] for r in ordering.sums_before(rows.repartition(7), ["k"], F.col("k")).collect()}
    total = 0
    for k in sorted(got):
        assert got[k] == total
        total += k


def test_paths_are_normalized(spark):
    cases = {("a/b", "./c"): "a/b/c", ("a/b", "../c"): "a/c", ("", "../c"): "../c", ("a", "../.."): "..", ("a", ".."): ".", ("", "x//y/."): "x/y"}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "base string, path string, want string")
    assert rows.where(paths.joined(F.col("base"), F.col("path")) != F.col("want")).count() == 0



def test_reaching_over_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in graph.reaching(edges, spark.createDataFrame([(3,)], "node int")).collect()}
    assert got == {3: 0, 2: 1, 1: 2}


def test_the_stream_gives_what_the_table_gives(spark, tmp_path):
    import datetime as dt

    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, h) for i, (s, h) in enumerate([(1, "a"), (2, "x"), (1, "a"), (1, "b"), (2, "y"), (1, "a")])]
    schema = "session long, ts timestamp, ord long, head string"
    for i in (0, 1):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = sessions.moved_stream(stream).writeStream.outputMode("append").format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sessions.moved(spark.createDataFrame(rows, schema))
    assert sorted(spark.table("moved").collect()) == sorted(want.collect())


def test_labels_that_any_other_line_holds(spark):
    body = ["<h1>Save all</h1>", "<Button>Save</Button>", 'const t = "Close";', "<Button>Close</Button>", "<Button>Alone</Button>", "<Button>x</Button> x", "x"]
    body += [f"<Button>Item {i:02}</Button> Item {i:02}" for i in range(12)] + [f"  Item {i:02}\t" for i in range(12)] + ["Many"] * 12 + ["<Button>Many</Button>"]
    rows = [("a", i, t, "Alone" not in t) for i, t in enumerate(body, 1)] + [("b", 1, "Alone", True)]
    got = {(r["line"], r["label"]): [tuple(x) for x in r["same"]] for r in review.duplicate_labels(spark.createDataFrame(rows, "file string, line int, text string, added boolean")).collect()}
    want = {(2, "Save"): [(1, "<h1>Save all</h1>")], (4, "Close"): [(3, 'const t = "Close";')], (44, "Many"): [(i, "Many") for i in range(32, 42)]}
    assert got == want | {(8 + i, f"Item {i:02}"): [(20 + i, f"Item {i:02}")] for i in range(12)}


def test_union_of_ranges_is_dealt_by_its_rows(spark, monkeypatch):
    from gristmill.functions import ordering
    from gristmill.plans import formats

    monkeypatch.setattr(ordering, "TASK", 500)
    plan = formats.union_of_ranges(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert f", {-(-rows // 500)}" in plan.optimizedPlan().toString()
    # Nothing is sorted before it is dealt.
    assert "partial_max(text" not in plan.executedPlan().toString().split("Exchange", 1)[1].split("Scan", 1)[0]


def test_manifests_are_dealt_by_their_number(spark, monkeypatch):
    from gristmill.functions import ordering
    from gristmill.operators import supply

    monkeypatch.setattr(ordering, "TASK", 100)
    texts = spark.range(24).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit('[project]\ndependencies = ["a>=1"]').alias("text"))
    found = supply.python_dependencies(texts.withColumnRenamed("id", "file"))
    assert found.rdd.getNumPartitions() == 12
    assert found.count() == 24


def test_headers_of_tests_are_read_once(spark):
    changed = spark.range(3).selectExpr("'a.test.ts' AS file", "id AS hunk_ord", "int(id) AS new_start", "'-' AS side", "1 AS line", "'it(\"x\", f)' AS text")
    found = tamper.deleted_tests(changed)
    # What remains is the look for deleted files.
    assert found._jdf.queryExecution().analyzed().toString().count("Range (") == 1
    assert found.count() == 3
