"""Manifests, SentencePiece ids and spelling variants against brute force, with hard rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from gristmill.llm import manifest, oracles, pieces, registry, shared, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `group` string, node string, rank long, idx int, path string"
HARD = [None, "", " \n\t ", "a", "A b  c", "tab\tand\nlines\r\n", "\U0001f600 日本語 éè", "x" * 5000, "no spaces" * 900, "same text", "same text", "<s> </s> <0x0A>", "\0 nul", "▁▁ ▁a", "a  b   c \n d"]
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def documents(spark, rows):
    """(doc_id, text, source) rows, with every column that an operator might clash with."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, 2, "z") for i, t, s in rows], DOCS)


# Manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(nodes, fanout):
    """Root and the path of each node, by plain lists."""
    paths, owners, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        runs = range(0, len(now), fanout)
        for r in runs:
            for k in range(r, min(r + fanout, len(now))):
                for o in owners[k]:
                    paths[o].append(("".join(now[r:k]), "".join(now[k + 1 : r + fanout])))
        owners = [sum(owners[r : r + fanout], []) for r in runs]
        now = [sha(*now[r : r + fanout]) for r in runs]
    return now[0], paths


def plain_manifest(rows, fanout=3):
    found, groups = [], defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        trees.append((own, *plain_tree([plain_leaf(r, r["text"]) for r in own], fanout)))
    root, upper = plain_tree([t[1] for t in trees], fanout)
    for (own, subroot, paths), above in zip(trees, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            whole, text = path + above, r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf(r, text)
            for left, right in whole:
                folded = sha(left, folded, right)
            found.append((r["doc_id"], plain_leaf(r, r["text"]), subroot, root, sha(*(a + b for a, b in whole)), folded, folded == root))
    return sorted(found, key=repr)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_of_hard_rows(spark, fanout):
    rng = random.Random(3)
    rows = [(i, t, s) for i, t in enumerate(HARD) for s in ("one", None, "")] + [(None, "no id\n", "one"), (None, None, None), (5, "again", "one"), (5, "again", "one"), (7, "a\nb", "sole"), (2**53 + 1, "\n", "Sole"), (-4, "x\n", "é")]
    rows += [(100 + i, f"text {i}\n", "hot" if rng.random() < 0.5 else f"s{i % 11}") for i in range(150)]
    docs = documents(spark, rows).repartition(5)
    got = manifest.verify(spark, docs, manifest.without_line_ends(), fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest([r.asDict() for r in docs.collect()], fanout)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, "a\n", None)], [(1, "a", "s"), (1, "a", "s")], [(1, None, "s"), (2, "b", "t")]):
        docs = documents(spark, rows)
        got = manifest.verify(spark, docs, manifest.without_line_ends()).collect()
        assert sorted(map(tuple, got), key=repr) == (plain_manifest([r.asDict() for r in docs.collect()]) if rows else [])


def test_numbers_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    got = shared.numbered(spark, rows, "g", ["k"])
    want = {g: sorted(r["k"] for r in rows.where(F.col("g") == g).collect()) for g in ("rare", "hot")}
    assert {(r["g"], r["idx"], r["k"], r["n"]) for r in got.collect()} == {(g, i, k, len(ks)) for g, ks in want.items() for i, k in enumerate(ks)}


# SentencePiece


def test_ids_are_the_librarys(spark):
    rng, found = random.Random(4), pieces.Encoder(pieces.DEFAULT_MODEL)
    texts = [t or "" for t in HARD] + ["".join(rng.choice(" \n\t'.,aAé日1\x1c\x85\xa0…▁ther in<s>\0﻿\U0001f600") for _ in range(rng.randrange(90))) for _ in range(800)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(n)) for n in (31, 32, 33, 500, 20000)]
    want = found.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for at in range(0, len(texts), 70):
        for text, got, ids in zip(texts[at : at + 70], found.batch(texts[at : at + 70]), want[at : at + 70], strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids, repr(text[:80])
    assert found.merge("heretherein") == found._merge_long("heretherein")


def test_a_difference_from_the_library_is_an_error():
    found = pieces.Encoder(pieces.DEFAULT_MODEL)
    found.order = {p: -s for p, s in found.order.items()}
    with pytest.raises(ValueError, match="does not encode"):
        found.batch(["therein is another"])


def test_round_trip_of_hard_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate(HARD)] + [(None, "no id", None), (1, "again", "s"), (2**53 + 1, "large id", "s")]
    got = pieces.round_trip(spark, documents(spark, rows))
    library = pieces.encoder().library
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, ids, library.decode(ids)))
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert pieces.digests(spark, documents(spark, [])).collect() == []


@needs_tables
def test_digests_of_documents(spark):
    docs, library = spark.read.parquet(f"{SF}/documents.parquet"), pieces.encoder().library
    want = set()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert set(map(tuple, registry.op12_sentencepiece(spark, SF).collect())) == want


# Spelling variants


def plain_words(rows):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(counts):
    forms, out = {}, []
    for w, n in counts.items():
        around = [x for x in counts if x != w and near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        forms[w] = form
        out.append([w, form, None, n, len(around), counts[form] if form else None])
    for row in out:
        at = row[0]
        while forms[at] is not None:
            at = forms[at]
        row[2] = at
    return {tuple(r) for r in out}


def word_rows(rng):
    """Words whose variants lie a letter apart, with counts that make chains of forms."""
    texts = []
    for base in ("international", "aabbaabb", "éèéèéèéè", "committee", "x" * 40):
        for w, n in [(base, 1200), (base[:-1], 110), (base[:3] + "q" + base[3:], 100), (base[:3] + "qz" + base[4:], 9), (base[:2] + base[3:], 10), (base[1:], 3), (base + base[-1], 120), (base.upper(), 4), ("z" + base[1:], 12)]:
            texts += [w] * n
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "×", "-", "1", "\n"]).join(texts[i::60]) if i % 7 else " ".join(texts[i::60]), "s") for i in range(60)]


def test_variants_of_hard_rows(spark):
    rng = random.Random(5)
    rows = word_rows(rng) + [(None, "international committee comittee", "s"), (3, None, "s"), (3, "", "s"), (4, "committee Committee", "s"), (4, "committee Committee", "s"), (9, "日本語 Straße straßen STRASSEN", None)]
    rows += [(1000 + i, "w" * 30000 + " " + "w" * 29999 + "v", "s") for i in range(3)]
    docs = documents(spark, rows).repartition(4)
    got = spelling.variants(spark, docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found, want = list(map(tuple, got.collect())), plain_variants(plain_words(rows))
    assert len(found) == len(set(found)) and set(found) == want
    assert any(r[1] is not None and r[2] != r[1] for r in want)
    assert spelling.variants(spark, documents(spark, [])).collect() == spelling.variants(spark, documents(spark, [(1, None, None)])).collect() == []


def test_keys_meet_as_strings_do():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    found, groups = spelling.word_keys(words), defaultdict(set)
    for of, kind, a, b in zip(found["of"], found["kind"], found["a"], found["b"], strict=True):
        groups[kind == spelling.OPEN, a, b].add((int(of), int(kind)))
    want = defaultdict(set)
    for i, w in enumerate(words):
        want[False, w].add((i, spelling.WORD))
        for k in range(len(w)):
            want[False, w[:k] + w[k + 1 :]].add((i, spelling.SHORTER))
            want[True, w[:k] + "\0" + w[k + 1 :]].add((i, spelling.OPEN))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@needs_tables
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_spelling_variants"])
def test_oracle(spark, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.ORACLES[name]) == ""
    assert registry.ORACLES[name] in (oracles.MANIFEST, oracles.SPELLING)
