"""Scans over long groups: against plain loops, with a group of null and with more ranges than one."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions.scan import Scan
from gristmill.sources import coverage, diffs, lockfiles


@pytest.fixture()
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def lines(spark, docs):
    rows = [(doc, i, t) for doc, body in docs.items() for i, t in enumerate(body)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc string, ord int, text string")


def test_running_columns(spark, many_ranges):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(4), rng.choice([None, None, None, "a", "b", "c"])) for g, n in (("long", 900), ("short", 3), (None, 40), ("one", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "g string, i int, n int, v string")
    scan = Scan(table, ["g"], ["i"])
    assert scan._rows.where("g = 'long'").select("_range").distinct().count() > 5
    got = {(r["g"], r["i"]): (r["s"], r["v_last"], r["v_last_s"]) for r in scan.read({"s": F.col("n")}, {"v_last": F.col("v")}).rows.collect()}
    want, state = {}, {}
    for g, i, n, v in rows:
        total, last = state.get(g, (0, (None, None)))
        last = last if v is None else (v, total)
        want[g, i] = (total, *last)
        state[g] = (total + n, last)
    assert got == want
    assert Scan(table.limit(0), ["g"], ["i"]).read({"s": F.col("n")}, {"v_last": F.col("v")}).rows.count() == 0


def plain_diff(body):
    """One pass over the lines with the state in variables."""
    out, minus, plus, left, hunk = [], None, None, (0, 0), 0
    old = new = 0
    for text in body:
        head = re.match(diffs.HUNK, text)
        if head:
            hunk += 1
            old, new = int(head[1]), int(head[3])
            starts, left = (old, new), (int(head[2] or 1), int(head[4] or 1))
        elif left[0] > 0 or left[1] > 0:
            sign = text[:1]
            if sign in "+-" and sign:
                gone = plus == "/dev/null"
                out.append((minus if gone else plus, hunk, *starts, sign, new if sign == "+" else old, text[1:]))
            a, b = sign in "- ", sign in "+ "
            old, new, left = old + a, new + b, (left[0] - a, left[1] - b)
        elif text.startswith("--- "):
            minus = re.sub(r"^[ab]/|\t.*$", "", text[4:])
        elif text.startswith("+++ "):
            plus = re.sub(r"^[ab]/|\t.*$", "", text[4:])
    return out


def some_diff(rng, files):
    body = []
    for f in range(files):
        gone = rng.random() < 0.2
        body += [f"diff --git a/f{f} b/f{f}", "index 1..2", f"--- a/f{f}\tnow", "+++ /dev/null" if gone else f"+++ b/f{f}"]
        at = 1
        for _ in range(rng.randrange(1, 4)):
            a, b = rng.randrange(0, 40), 0 if gone else rng.randrange(0, 40)
            marks = ["-"] * a + ["+"] * b + [" "] * rng.randrange(2)
            a, b = a + marks.count(" "), b + marks.count(" ")
            body.append(f"@@ -{at}{'' if a == 1 else f',{a}'} +{at}{'' if b == 1 else f',{b}'} @@ def f():")
            rng.shuffle(marks)
            body += [m + rng.choice(["-- a/x", "++ b/y", " text", "", "@@ -1 +1 @@", "diff --git a b"]) for m in marks]
            at += 50
        if rng.random() < 0.3:
            body.append("\\ No newline at end of file")
    return body


def test_one_long_diff_in_many_ranges(spark, many_ranges):
    rng = random.Random(2)
    docs = {"long": some_diff(rng, 60), "short": some_diff(rng, 2), "none": ["just text"], None: some_diff(rng, 5)}
    found = diffs.parse_diff(lines(spark, docs)).collect()
    got = {d: sorted((r["ord"], r["file"], r["hunk_ord"], r["old_start"], r["new_start"], r["side"], r["line"], r["text"]) for r in found if r["doc"] == d) for d in docs}
    for d, body in docs.items():
        assert [x[1:] for x in got[d]] == plain_diff(body), d
    assert len(got["long"]) > 1000


def test_one_long_report_in_many_ranges(spark, many_ranges):
    rng = random.Random(3)
    body, want = [], {}
    for f in range(120):
        body += ["TN:", f"SF:/repo/f{f % 50}"]
        for line in range(rng.randrange(1, 20)):
            body.append(f"DA:{line},{(hits := rng.randrange(3))}" + rng.choice(["", ",sum"]))
            want[f"f{f % 50}", line] = want.get((f"f{f % 50}", line), 0) + hits
        body += ["LF:1", "end_of_record"]
    broken = body[:700] + ["DA:9,1" if body[700].startswith(("TN", "SF")) else "SF:x"] + body[700:]
    rows = lines(spark, {"a": body, "b": broken + ["SF:x"], "c": ["DA:1,1"]})
    got = coverage.parse_lcov(rows, "/repo").where("doc = 'a'").collect()
    assert {(r["file"], r["line"]): r["hits"] for r in got} == want
    assert {r["doc"]: r["valid"] for r in coverage.valid_lcov(rows).collect()} == {"a": True, "b": False, "c": False}


def test_one_long_lock_in_many_ranges(spark, many_ranges):
    npm, python, pnpm, want = ['{', '  "packages": {'], [], ["packages:"], {"npm": [], "python": [], "pnpm": []}
    for k in range(300):
        want["npm"].append((f"n{k}", f"1.0.{k}", len(npm) + 1))
        npm += [f'    "node_modules/n{k}": {{', f'      "version": "1.0.{k}",', '      "resolved": "https://r/x.tgz"', "    },"]
        want["python"].append((f"p{k}", f"2.{k}", len(python) + 1))
        python += ["[[package]]", f'name = "p{k}"', f'version = "2.{k}"', 'source = { registry = "https://r" }', ""]
        want["pnpm"].append((f"q{k}", f"3.{k}.0", len(pnpm) + 1))
        pnpm += [f"  'q{k}@3.{k}.0':", "    resolution: {integrity: x}"]
    for name, body, parse in (("npm", npm, lockfiles.parse_package_lock), ("python", python, lockfiles.parse_python_lock), ("pnpm", [*pnpm, "snapshots:", "  late@1.0.0:"], lockfiles.parse_pnpm_lock)):
        got = parse(lines(spark, {"x": body})).collect()
        assert sorted((r["name"], r["version"], r["line"]) for r in got) == sorted(want[name]), name


def test_ranges_are_small_and_shuffled_once(spark, monkeypatch):
    """A long group is cut into ranges of BLOCK rows however few tasks there are, and all readers share a shuffle of whole rows."""
    from gristmill.functions import scan as module

    monkeypatch.setattr(module, "BLOCK", 64)
    table = spark.range(1000).selectExpr("'g' as g", "id as i", "if(id % 7 = 0, id, null) as v", "repeat('x', 20) as text")
    found = Scan(table, ["g"], ["i"])
    assert found._rows.groupBy("_range").count().agg({"count": "max"}).first()[0] <= 64
    got = found.read({"s": F.lit(1)}, {"last": F.col("v")}).rows
    assert {(r["i"], r["s"], r["last"], r["last_s"]) for r in got.collect()} == {(i, i, i - i % 7, i - i % 7) for i in range(1000)}


def test_as_many_tasks_sort_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr("gristmill.functions.ordering.TASK", 400)
    body = [x for i in range(500) for x in (f"SF:f{i}", "DA:1,1", "DA:1,2")]
    table = lines(spark, {"long": body, "short": body[:3]})
    scan = Scan(table, ["doc"], ["ord"])
    # Four partitions of the session would sort 376 whole rows each.
    assert scan.size == 1503 and scan._rows.groupBy("_range").count().agg(F.max("count")).first()[0] <= 200
    found = coverage.parse_lcov(table)
    assert found.rdd.getNumPartitions() >= 4 and found.where("hits = 3").count() == 501
