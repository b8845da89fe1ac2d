"""Clones against a brute force over all windows."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gristmill.operators import clones as C
from gristmill.operators.ingest import clone_findings


def brute(files):
    """(file, start, end, first file, start, end, tokens) by a table of all windows; files are in order and each once."""
    at, out = {}, {}
    for name, text in files:
        words, line = [], 1
        for t in re.findall(C.TOKEN, text):
            if t == "\n":
                line += 1
            else:
                words.append((t, line))
        run = None
        for i in range(len(words) - C.TOKENS + 1):
            first = at.setdefault(tuple(t for t, _ in words[i : i + C.TOKENS]), (name, i, words[i][1], words[i + C.TOKENS - 1][1]))
            if first[0] == name and i - first[1] < C.TOKENS:
                continue
            end, key = words[i + C.TOKENS - 1][1], (name, first[0], i - first[1])
            if run is not None and run[0] == key and run[1] == i - 1:
                out[run[2]][2:] = [end, first[3], out[run[2]][4] + 1]
                run = (key, i, run[2])
            else:
                run = (key, i, (name, i))
                out[name, i] = [words[i][1], (first[0], first[2]), end, first[3], C.TOKENS]
    return sorted((n, a, b, of, la, lb, size) for (n, _), (a, (of, la), b, lb, size) in out.items())


def rows(df):
    got = df.select("b.file", "b.start", "b.end", F.col("a.file").alias("of"), F.col("a.start").alias("la"), F.col("a.end").alias("lb"), "tokens").collect()
    return sorted(tuple(r) for r in got)


def texts(seed):
    """Texts that share stretches of 40 to 200 tokens, some within one text, some in places that overlap."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    stretch = lambda n: "".join(word() + r.choice([" ", " ", " ", "\n", "\n\n", " + "]) for _ in range(n))
    shared = [stretch(n) for n in (40, 69, 70, 71, 72, 90, 117, 200)]
    out = []
    for i in range(40):
        parts = [r.choice(shared) if r.random() < 0.5 else stretch(r.randrange(5, 60)) for _ in range(r.randrange(1, 9))]
        out.append((i, "".join(parts)))
    return [*out, (90, shared[-1] + shared[-1]), (91, "x " * 400), (92, "x " * 300), (93, "p q r s t u v " * 50)]


def test_clones_equal_brute_force(spark):
    for seed in (1, 2, 3):
        files = texts(seed)
        want = brute(files)
        got = rows(C.found_clones(spark.createDataFrame(files, "file long, text string")))
        assert got == want and len(got) > 60


def test_a_stretch_of_the_least_length_is_found_anywhere(spark):
    r = random.Random(7)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    files, want = [], []
    for i in range(60):
        both, lead = fresh(C.TOKENS), r.randrange(0, 90)
        files += [(2 * i, " ".join(fresh(40) + both + fresh(30))), (2 * i + 1, "\n".join(fresh(lead) + both + fresh(20)))]
        want.append((2 * i + 1, lead + 1, lead + C.TOKENS, 2 * i, 1, 1, C.TOKENS))
    assert rows(C.found_clones(spark.createDataFrame(files, "file long, text string"))) == sorted(want)


def test_copies_are_linear_and_odd_rows_go_through(spark):
    text = "\n".join(f"line {i} = call({i}, {i * i})" for i in range(40))
    files = [(i, text, "x") for i in range(300)] + [(7, text, "x"), (None, text, "x"), (400, None, "x"), (401, "", "x"), (402, "\n\n", "x"), (403, "one two", None)]
    df = spark.createDataFrame(files, "file long, text string, doc string")
    got = rows(C.found_clones(df))
    size = len(re.findall(r"\w+|[^\w\s]", text))
    assert got == [(i, 1, 40, None, 1, 40, size) for i in range(300)]
    assert C.found_clones(df.limit(0)).count() == 0
    # One name with two texts: two files.
    two = spark.createDataFrame([("f", text + "\nend"), ("f", text)], "file string, text string")
    assert [(r.a.file, r.b.file, r.lines) for r in C.found_clones(two).collect()] == [("f", "f", 40)]


def test_found_clones_become_findings(spark):
    text = "\n".join(f"line {i} = call({i}, {i * i})" for i in range(40))
    clones = C.found_clones(spark.createDataFrame([("a.ts", "top\n" + text), ("b.ts", text + "\nend")], "file string, text string"))
    touched = spark.createDataFrame([("b.ts", 40)], "file string, line int")
    assert [tuple(r) for r in clone_findings(clones, touched).collect()] == [("dup/jscpd", "b.ts", 1, "40 duplicated lines with a.ts:2-41")]
