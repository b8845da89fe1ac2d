"""Phrases, beginnings and labels against patterns and plain loops."""

from __future__ import annotations

import random
import re
import time

import pytest
import regex

from gristmill.operators import review
from gristmill.operators import tamper
from gristmill.operators import text as texts


def brute(rows, terms):
    p = regex.compile(r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(map(regex.escape, terms)) + r")(?![\p{L}\p{N}_])")
    return {(f, n): m[1] for f, n, t in rows if t and (m := p.search(t))}


def found(spark, rows, terms):
    lines = spark.createDataFrame(rows, "file string, line int, text string")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, ord int")
    got = texts.glossary_findings(lines, table).collect()
    assert len({(r.file, r.line) for r in got}) == len(got) and {r.rule for r in got} <= {"glossary"}
    return {(r.file, r.line): r.msg[len('Avoid word "') : -1] for r in got}


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_terms_of_a_table_are_those_of_a_pattern(spark, limit):
    rng = random.Random(3)
    parts = ["a", "B", "été", "ÉTÉ", "c++", "+", "_", " ", "  ", "-", "x1", "É", ".", "ß", "ẞ", "ss", "д", "\t", "𝒳", "数", "the"]
    rows = [("f", i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(1500)] + [("g", 1, None), (None, 2, "the"), ("g", None, "c++")]
    terms = ["c++", "the", "été a", "a", "a b", "a-", "+", ".", "_", "x1 the", "ß", "数", "𝒳 ", "a b c d e f", "A B", "д"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        assert found(spark, rows, terms) == brute(rows, terms)
        assert found(spark, rows, ["", *terms[3:5], "a"]) == brute(rows, terms[3:5])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_terms_and_no_lines(spark):
    assert found(spark, [("f", 1, "a")], []) == {} == found(spark, [], ["a"]) == found(spark, [("f", 1, "")], ["a"])


def test_long_lines_and_many_terms(spark):
    terms = [f"w{i} w{i + 1}" for i in range(0, 200_000, 2)]
    rows = [("f", 1, "w1 " * 300_000 + "W7 w8, w6 w7 w8 w9"), ("f", 2, "w3 w4 w5 " * 1000), ("f", 3, "-".join(f"w{i}" for i in range(1000)) + " w1000")]
    assert found(spark, rows, terms) == {("f", 1): "w6 w7", ("f", 2): "w4 w5"}
    assert found(spark, rows, [*terms, "w998-w999"]) == {("f", 1): "w6 w7", ("f", 2): "w4 w5", ("f", 3): "w998-w999"}


def test_commit_notes_take_a_table(spark):
    messages = spark.createDataFrame([(1, "fix the utilise\n# utilise"), (2, "fine"), (3, None)], "doc int, text string")
    terms = spark.createDataFrame([("utilise", 0)], "term string, ord int")
    assert sorted(map(tuple, texts.commit_notes(messages, terms).collect())) == sorted(map(tuple, texts.commit_notes(messages, ["utilise"]).collect()))


def test_beginnings_of_tokens(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("ab/é", k=rng.randint(0, 6))) for _ in range(40)] + [None]
    rows = [("d", i, " ".join("`" + "".join(rng.choices("ab/é", k=rng.randint(1, 9))) + "`" for _ in range(3))) for i in range(200)] + [("d", 999, None)]
    rows.append(("d", 1000, "`" + "ab" * 50_000 + "`"))
    want = {(f, i, n) for f, i, t in rows if t for k in re.findall("`([^`\n]+)`", t) for n in names if n and k.strip().startswith(n)}
    lines, gone = spark.createDataFrame(rows, "file string, line int, text string"), spark.createDataFrame([(n,) for n in names], "file string")
    assert {tuple(r) for r in texts.deleted_references(lines, gone).collect()} == want
    assert texts.deleted_references(lines, gone.where("false")).count() == 0


def test_ends_of_stubs(spark):
    long = "mock" + "Save" * 25_000
    rows = [("a", 1, "function fakeSave() {"), ("a", 2, f"function {long}() {{"), ("a", 3, "function mockLoads() {"), ("a", 4, "function resave() {"), ("a", 5, "function doSave() {"), ("a", 6, "function load() {")]
    added = spark.createDataFrame(rows, "file string, line int, text string")
    names = spark.createDataFrame([(None, "Save", 1, 0), ("a", "load", 0, 1), ("b", "oads", 0, 2), (None, None, 1, 3)], "file string, name string, rank int, ord int")
    assert sorted(map(tuple, tamper.stub_shadows(added, names).collect())) == [("a", 1, "Save"), ("a", 2, "Save"), ("a", 4, "Save"), ("a", 6, "load")]


def labels(rows, most=10):
    out = {}
    for f, n, t, added in rows:
        m = re.search(r"<Button\b[^>]*>\s*([^<]*\S)\s*</", t or "") if added else None
        if m and len(m[1]) > 1:
            same = sorted((k, x.strip()) for g, k, x, _ in rows if g == f and x and m[1] in x)[: most + 1]
            same = [p for p in same if p[0] != n][:most]
            if same:
                out[f, n, m[1]] = same
    return out


def test_labels_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(review, "LINE_BLOCK", 7)
    monkeypatch.setattr(review, "LABEL_PART", 3)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abé ", k=rng.randint(1, 4))).strip() or "a"
    rows = [(rng.choice("fgh"), i, rng.choice([f"<Button> {word()} </Button>", f" {word()} {word()}", "<Button>ab</Button>"]), rng.random() < 0.5) for i in range(300)]
    rows += [("f", 400, None, True), (None, 1, "<Button>ab</Button>", True), ("z", 1, "ab", True)]
    got = review.duplicate_labels(spark.createDataFrame(rows, "file string, line int, text string, added boolean")).collect()
    assert {(r.file, r.line, r.label): [tuple(x) for x in r.same] for r in got} == labels(rows)


def test_a_file_of_100_000_lines(spark):
    rows = [("f", i, f"<Button>Item {i % 30_000:05}</Button>", True) for i in range(100_000)]
    frame = spark.createDataFrame(rows, "file string, line int, text string, added boolean")
    start = time.monotonic()
    got = review.duplicate_labels(frame).agg({"line": "count"}).first()[0]
    assert got == 100_000 and time.monotonic() - start < 60


def test_lines_far_apart_are_few_groups(spark):
    """Line numbers with gaps do not cost a group each: 3000 files of 20 lines, 10 000 numbers from one to the next."""
    frame = spark.range(60_000).selectExpr("id % 3000 as file", "id * 10000 as line", "concat('<Button>Item ', id % 7, '</Button>') as text", "true as added")
    start = time.monotonic()
    got = review.duplicate_labels(frame).selectExpr("count(*) as n", "min(same[0].line % 10000) as m").first()
    assert tuple(got) == (60_000, 0) and time.monotonic() - start < 30
