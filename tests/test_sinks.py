"""Sinks that a dying writer cannot spoil, and JSON of any depth."""

from __future__ import annotations

import json
import random

import pytest

from gristmill.functions import commits, deepjson
from gristmill.operators import report, supply
from gristmill.sources import coverage, reports


@pytest.fixture()
def tables(spark):
    def make(n):
        functions = spark.createDataFrame([(f"a::{i}", i, n, float(n)) for i in range(n)], "key string, line int, cc int, crap double")
        return functions, spark.createDataFrame([("file", str(i)) for i in range(n)], "kind string, name string")

    return make


def sizes(spark, path):
    held = report.read_baseline(spark, path)
    return held["functions"].count(), held["dead"].count(), held["mean"].first()["mean_crap"]


def test_a_baseline_is_replaced_as_a_whole(spark, tmp_path, tables, monkeypatch):
    path = f"{tmp_path}/b"
    report.write_baseline(*tables(2), path, False, True)
    report.write_baseline(*tables(3), path, False, True)
    assert sizes(spark, path) == (3, 3, 3.0)
    with pytest.raises(Exception, match="x"):  # dies while it writes the last table
        functions, dead = tables(5)
        report.write_baseline(functions, dead.selectExpr("kind", "raise_error('x') AS name"), path, False, True)
    assert sizes(spark, path) == (3, 3, 3.0)

    rename, calls = commits._rename, []

    def dying(spark, old, new):  # dies between the renames
        calls.append(old)
        if len(calls) == 2:
            raise KeyboardInterrupt
        rename(spark, old, new)

    monkeypatch.setattr(commits, "_rename", dying)
    with pytest.raises(KeyboardInterrupt):
        report.write_baseline(*tables(6), path, False, True)
    monkeypatch.undo()
    assert not (tmp_path / "b").exists()
    assert sizes(spark, path) == (3, 3, 3.0)
    report.write_baseline(*tables(4), path, False, True)
    assert sizes(spark, path) == (4, 4, 4.0) and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["b"]


def test_a_cache_may_be_rewritten_from_itself(spark, tmp_path):
    path = f"{tmp_path}/c"
    first = spark.createDataFrame([("npm:a@1", "old")], "key string, published string")
    states = lambda name: spark.createDataFrame([("npm", name, "1", "old", "new")], "registry string, name string, version string, state string, published string")
    supply.write_cache(first, states("b"), path)
    for name in ("c", "c"):
        supply.write_cache(spark.read.schema(first.schema).json(path), states(name), path)
    assert {tuple(r) for r in spark.read.schema(first.schema).json(path).collect()} == {("npm:a@1", "old"), ("npm:b@1", "new"), ("npm:c@1", "new")}


def test_a_batch_counts_once(spark, tmp_path):
    path, rows = f"{tmp_path}/log", spark.range(3).selectExpr("id", "'q' AS question")
    for batch in ("1", "2", "1"):
        report.append_log(rows, path, batch)
    with pytest.raises(Exception, match="x"):
        report.append_log(rows.selectExpr("raise_error('x') AS id"), path, "3")
    assert spark.read.json(path).count() == 6
    report.append_log(rows, path, "3")
    assert spark.read.json(path).count() == 9


DEEP = 20_000


def test_the_deep_reader_reads_what_the_standard_one_reads():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(8 if depth < 4 else 5)
        simple = [None, rng.randrange(100), -1.5e3, True, 'a"\\\u00e9\n{[']
        if kind < 5:
            return simple[kind]
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind < 6 else {rng.choice(["a", "b", "c d", ""]): value(depth + 1) for _ in range(rng.randrange(4))}

    for i in range(300):
        text = json.dumps(v := value(0), indent=rng.choice([None, 1]))
        assert deepjson._read_deep(text, 0) == (v, len(text))
        broken = text[: (at := rng.randrange(len(text)))] + rng.choice(["", ",", "}", "]", ":", '"']) + text[at + 1 :]
        try:
            want = (json.loads(broken), len(broken.rstrip()))
        except ValueError:
            want = None
        try:
            got = deepjson._read_deep(broken, 0)
        except ValueError:
            got = None
        # What follows a value is its caller's.
        assert got == want or want is None and got is not None and got[1] < len(broken.rstrip()), broken
    deep = deepjson.read("[" * DEEP + "]" * DEEP)
    for _ in range(DEEP - 1):
        deep = deep[0]
    assert deep == []
    for text in ("[" * DEEP, "[" * DEEP + "]" * (DEEP - 1) + "}", "", "[1] 2"):
        with pytest.raises(ValueError):
            deepjson.read(text)


def test_findings_of_deep_texts(spark):
    one = '{"message": "m", "file": "f%d", "line": 3, "rule": "r"}'
    texts = ['{"x": ' * DEEP + one % 1 + "}" * DEEP, "[" * DEEP + one % 2 + "]" * DEEP + "\n" + one % 3, "[" * DEEP, None, "", one % 4, '{"message": "m", "file": ' + "[" * DEEP + "]" * DEEP + "}"]
    got = reports.parse_generic(spark.createDataFrame([(t,) for t in texts], "text string"), "p").collect()
    assert sorted((r["rule"], r["file"], r["line"]) for r in got) == [("p/r", f"f{i}", 3) for i in (1, 2, 3, 4)] + [("p/unreadable", ".", 0)]


def test_audits_and_blocks_of_deep_texts(spark):
    item = '{"severity": "high", "name": "n", "id": "i"}'
    texts = [(1, '{"a": ' * DEEP + item + "}" * DEEP), (2, "{" * DEEP), (3, f"[{item}]")]
    got = reports.walked(spark.createDataFrame(texts, "doc long, text string")).collect()
    assert sorted((r["doc"], r["package"], r["severity"]) for r in got) == sorted([(1, "n", "high"), (2, None, "error"), (3, "n", "high")], key=str)

    block = lambda i, inner: f'{{"type": "function", "name": "f{i}", "complexity": {i % 9}, "lineno": {i}, "endline": 9, "col_offset": 0, "closures": [{inner}]}}'
    head, tail = block(1, "@").split("@")
    text = '{"a.py": [' + head * DEEP + tail * DEEP + "]}"
    found = coverage.parse_complexity_json(spark.createDataFrame([(text,), ("[" * DEEP,), (None,)], "text string"))
    assert found.where("file = 'a.py'").count() == DEEP and found.where("name is null").count() == 1
