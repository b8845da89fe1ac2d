"""Chains of configs and interval joins against plain loops."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from gristmill.functions import intervals
from gristmill.operators import complexity, graph


def test_chain_ends_are_those_of_a_loop(spark):
    rng = random.Random(1)
    links = {i: (i + 1 if i % 150 != 149 else None) for i in range(600)}
    links |= {1000 + i: 1000 + (i + 1) % 37 for i in range(37)} | {2000: 2000, 2001: 1005, 2002: 9999, 2003: 2002, 2004: None, 2005: 140}
    rows = [(k, v) for k, v in links.items()] + [(5, 6), (2004, None)]
    rng.shuffle(rows)
    want = {}
    for node in links:
        seen, at = set(), node
        while links[at] in links and at not in seen:
            seen.add(at)
            at = links[at]
        if at not in seen:
            want[node] = at
    found = graph.chain_ends(spark.createDataFrame(rows, "node long, next long")).collect()
    assert {r["node"]: r["end"] for r in found} == want and len(found) == len(want)


def test_a_chain_of_a_thousand_configs(spark):
    rows = [(f"c{i}.json", '{"extends": "./c%d"}' % (i + 1)) for i in range(1000)] + [("c1000.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}')]
    rows += [("loop/a.json", '{"extends": "./b.json"}'), ("loop/b.json", '{"extends": "./a"}'), ("out.json", '{"extends": "../x"}'), ("none.json", "{}"), ("gone.json", '{"extends": "./missing"}'), ("c0.json", '{"extends": "./c1"}'), ("null.json", None)]
    configs = spark.createDataFrame(rows, "file string, text string")
    began = time.time()
    got = {r["file"]: [a["path"] for a in r["aliases"]] for r in graph.inherited_aliases(configs).collect()}
    assert got == {f"c{i}.json": ["src/*"] for i in range(1001)}
    assert time.time() - began < 60
    assert graph.inherited_aliases(configs.limit(0)).count() == 0


def test_blocks_cover_ranges_exactly(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.choice([0, 1, 14, 15, 16, 17, 255, 256, 300, 5000])) for a in [*range(40), *(rng.randrange(10**6) for _ in range(60))]] + [(7, 6), (-20, 40), (0, 2**31 - 1)]
    table = spark.createDataFrame(rows, "a long, b long").select("a", "b", intervals.cover(F.col("a"), F.col("b")).alias("c"))
    for r in table.collect():
        spans = sorted((x["block"] << x["level"], (x["block"] + 1 << x["level"]) - 1) for x in r["c"])
        assert len(spans) <= 300
        at = r["a"]
        for low, high in spans:
            assert low == at
            at = high + 1
        assert at == max(r["b"], r["a"] - 1) + 1
    assert spark.createDataFrame([(None, 3)], "a long, b long").select(F.size(intervals.cover(F.col("a"), F.col("b")))).first()[0] == 0


def test_interval_joins_of_a_long_file(spark):
    """10^5 ranges and as many lines in one file, nested three deep, beside files of null and of few rows."""
    rng, ranges, lines = random.Random(3), [], []
    for k in range(33_000):
        a = 30 * k
        ranges += [("long", a, a + 25, f"f{k}"), ("long", a + 2, a + 12, f"g{k}"), ("long", a + 2, a + 6, f"h{k}")]
        lines += [("long", a + rng.randrange(30)) for _ in range(rng.choice([0, 0, 3, 6]))]
    ranges += [("short", 5, 9, "s"), ("short", 5, 9, "s"), (None, 1, 9, "n"), ("short", None, 9, "x"), ("other", 1, 2, "o")]
    lines += [("short", 9), ("short", 4), (None, 4), ("short", None), ("none", 1)]
    held, owners = set(), {}
    for file, line in lines:
        if file == "long":
            a, at = line // 30 * 30, line % 30
            k = line // 30
            around = [n for n, low, high in (("f", 0, 25), ("g", 2, 12), ("h", 2, 6)) if low <= at <= high]
            held |= {f"{n}{k}" for n in around}
            if around:
                owners[file, line] = f"{around[-1]}{k}"
    owners["short", 9] = "s"
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "ord long, file string, start int, end int, name string")
    touched = spark.createDataFrame(lines, "file string, line int")
    got = [r["name"] for r in complexity.overlapping(table, touched).select("name").collect()]
    assert sorted(got) == sorted([*held, "s", "s"])
    found = complexity.innermost(table, touched).collect()
    assert {(r["file"], r["line"]): r["owner"] for r in found} == owners and len(found) == len(owners)
    nested = {r["name"]: [tuple(x) for x in r["nested"]] for r in complexity.nested_ranges(table.where("file = 'long'")).collect()}
    assert len(nested) == 99_000
    assert nested["f7"] == [(212, 216), (212, 222)] and nested["g7"] == nested["h7"] == []
    assert sum(map(len, nested.values())) == 66_000


def test_interval_joins_equal_brute_force(spark):
    rng = random.Random(4)
    ranges = [(i, rng.choice("ab"), a := rng.randrange(80), a + rng.randrange(-2, 40), f"r{i}") for i in range(120)]
    lines = [(rng.choice("abc"), rng.randrange(-3, 120)) for _ in range(30)]
    table, touched = spark.createDataFrame(ranges, "ord long, file string, start int, end int, name string"), spark.createDataFrame(lines, "file string, line int")
    inside = lambda r, x: r[1] == x[0] and r[2] <= x[1] <= r[3]
    assert sorted(r["ord"] for r in complexity.overlapping(table, touched).collect()) == [r[0] for r in ranges if any(inside(r, x) for x in lines)]
    want = {x: max((r[2], -r[3], r[4]) for r in ranges if inside(r, x))[2] for x in lines if any(inside(r, x) for r in ranges)}
    assert {(r["file"], r["line"]): r["owner"] for r in complexity.innermost(table, touched).collect()} == want
    for r in complexity.nested_ranges(table).collect():
        assert [tuple(x) for x in r["nested"]] == sorted((g[2], g[3]) for g in ranges if g[1] == r["file"] and g[2] > r["start"] and g[3] <= r["end"] and g[2] <= r["end"])


def test_lines_are_looked_up_by_the_sizes_that_ranges_have_room_for(spark):
    ranges = spark.createDataFrame([(1, "a", 3, 9), (2, "a", 4, 40), (3, "a", None, 5), (4, "b", 9, 2)], "ord long, file string, start int, end int")
    assert intervals.sizes_in_use(ranges, F.col("start"), F.col("end"))[0] == [0, 4]
    assert intervals.sizes_in_use(ranges.limit(0), F.col("start"), F.col("end")) == ([], 0)
    plan = intervals.contained_ranges(ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "(level, 4, block, shiftright" in plan and "(level, 8, block, shiftright" not in plan
    assert [tuple(r) for r in intervals.contained_ranges(ranges).collect()] == []
    named, lines = ranges.withColumn("name", F.col("ord")), spark.createDataFrame([("a", 7), ("a", 40), ("a", 41)], "file string, line int")
    assert {tuple(r) for r in intervals.innermost_ranges(named, lines).collect()} == {("a", 7, 2), ("a", 40, 2)}
    assert intervals.innermost_ranges(named.limit(0), lines).count() == 0


def test_many_blocks_of_few_ranges_are_dealt_by_their_number(spark, monkeypatch):
    from gristmill.functions import ordering
    from gristmill.operators import ingest

    monkeypatch.setattr(ordering, "TASK", 100)
    ranges = spark.range(200).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("start"), F.lit(10).alias("end"))
    plan = intervals.innermost_ranges(ranges.withColumn("name", F.col("end")), ranges.select("file", F.col("end").alias("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [file" in plan and ", 20" in plan
    # A message without text is judged by the function around it as others are.
    messages = spark.createDataFrame([("max-depth", "f1", 4, None), ("max-depth", "f1", 12, "m"), ("no-console", "f1", 4, "m")], "rule string, file string, line int, msg string")
    found = ingest.form_findings(messages, ranges, spark.createDataFrame([("f1", 9)], "file string, line int")).collect()
    assert [tuple(r) for r in found] == [("form/max-depth", "f1", 4, None)]


def test_circles_do_not_lengthen_the_rounds_of_chains(spark, monkeypatch):
    from gristmill.functions import ordering

    written, saved = [], ordering.saved
    monkeypatch.setattr(ordering, "saved", lambda rows: written.append(1) or saved(rows))
    # A chain of nine nodes, and a circle of 500 with a tail that leads into it.
    links = [(f"c{i}", f"c{i + 1}" if i < 8 else None) for i in range(9)] + [(f"o{i}", f"o{(i + 1) % 500}") for i in range(500)] + [("t1", "t0"), ("t0", "o3")]
    table = spark.createDataFrame(links, "node string, next string")
    checkpoint = type(table).checkpoint
    monkeypatch.setattr(type(table), "checkpoint", lambda rows: written.append(1) or checkpoint(rows))
    ends = graph.chain_ends(table)
    assert {tuple(r) for r in ends.collect()} == {(f"c{i}", "c8") for i in range(9)}
    assert len(written) <= 6


def test_files_are_matched_once_in_tasks_by_their_number(spark, monkeypatch):
    from gristmill.functions import ordering

    dealt, n = ordering.dealt, []
    monkeypatch.setattr(ordering, "dealt", lambda rows, count, *keys: n.append(count) or dealt(rows, count, *keys))
    files = spark.createDataFrame([("a/package.json",), ("a/package.json",), ("node_modules/x/package.json",)], "file string")
    assert [(r["language"], r["root"]) for r in graph.language_roots(files).collect()] == [("ts", "a")]
    assert n and n[0] == 16


def test_contained_ranges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("gristmill.functions.ordering.TASK", 20)
    found = intervals.contained_ranges(spark.range(30).selectExpr("id AS ord", "'f' AS file", "int(id) AS start", "int(60 - id) AS end"))
    # Some 990 blocks of both sides; the session has four partitions.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert sum("RepartitionByExpression" in x and x.rstrip().endswith(", 50") for x in plan.splitlines()) == 2
    assert found.count() == 435
