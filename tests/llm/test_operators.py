"""The ten operators against brute force, round trips and held-out labels, with hard rows among theirs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat, components, decontaminate, language, lattice, neardup, packing, pseudolm, quality, registry, rollups, secrets, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, comp long, _text string"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def words(rng, n, pool=400):
    return " ".join("w" + format(rng.randrange(pool) * 7919, "x") for _ in range(n))


def documents(spark, texts):
    """Rows with every column that an operator might clash with; doc_id counts from 0."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in enumerate(texts)], DOCS)


HARD = [None, "", " \n\t ", "a", "A b  c", "tab\tand\nlines\r\n", "\U0001f600 日本語 éè", "x" * 5000, "no spaces" * 900, "same text", "same text", "<|endoftext|> <|endoftext|>", "\0 nul", "a  b   c \n d"]


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


# Tokens and packing


def test_cached_ids_are_the_tokenizers():
    whole = tokens.encoder().tokenizer
    rng = random.Random(1)
    texts = [t or "" for t in HARD] + ["".join(rng.choice(" \n\t'.,aAé日1\x1c\x85\xa0…") for _ in range(60)) for _ in range(400)]
    for text, got in zip(texts, tokens.encoder().batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(5)}
        room, sums = rng.randrange(0, 60), {0}
        for k, c in counts.items():
            sums = {s + k * i for s in sums for i in range(c + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(k * c for k, c in chosen.items()) == max(s for s in sums if s <= room)
        assert all(c <= counts[k] for k, c in chosen.items())


def test_bins_hold_every_piece_once():
    rng = random.Random(3)
    histogram = Counter(rng.choice([1024, 1024, rng.randrange(1, 1025), rng.randrange(1, 60)]) for _ in range(3000))
    plan = packing.plan_bins(dict(histogram))
    assert all(sum(k * c for k, c in p.items()) <= 1024 for _, p in plan)
    total = Counter()
    for times, pattern in plan:
        total.update({k: c * times for k, c in pattern.items()})
    assert total == histogram
    least = -(-sum(k * c for k, c in histogram.items()) // 1024)
    assert sum(t for t, _ in plan) <= least + 1


def test_packing_round_trip(spark):
    rng = random.Random(4)
    texts = [*HARD, *(words(rng, n) for n in (3, 40, 900, 4000, 200, 200))]
    rows = [r.asDict() for r in packing.pack(spark, documents(spark, texts).repartition(5)).collect()]
    whole = tokens.encoder().tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc, pieces in by_doc.items():
        ids = [*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["length"] for r in pieces][1:] == [1024] * (len(pieces) - 1) and sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(spark, documents(spark, [])).count() == 0


# Near-duplicates


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def components_of(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_copies(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = "z" + format(rng.randrange(10**6), "x")
        out.append(" ".join(w))
    return out


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(5)
    one, two = words(rng, 120, 10**6), words(rng, 300, 10**6)
    texts = [*HARD, "A B C", "a b c", "a b", *near_copies(rng, one, 60, 2), one, one.upper(), *near_copies(rng, two, 30, 9), two, *(words(rng, 80) for _ in range(30))]
    sets = shingle_sets(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components_of(len(texts), links)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark, documents(spark, texts)).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(sets[i]), want[i], want[i] == i) for i in range(len(texts))]


def _around_one_text(n: int) -> list[str]:
    """Texts of one part of 100 words and 24 words of their own each: near one another, none linked."""
    common = " ".join(f"w{i}" for i in range(100))
    return [f"{common} " + " ".join(f"v{k}x{i}" for i in range(24)) for k in range(n)]


def test_near_duplicates_of_a_large_bucket_go_to_tasks_once(spark, monkeypatch):
    texts = _around_one_text(900)
    texts[700] = texts[5] + " more"
    rows, save = {}, neardup.shared.save

    def saved(session, df, name):
        out = save(session, df, name)
        if name == "hopeful":
            rows["all"], rows["different"] = out.count(), out.select("key", "id").distinct().count()
        return out

    monkeypatch.setattr(neardup.shared, "save", saved)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark, documents(spark, texts)).collect()}
    assert got == {i: 5 if i == 700 else i for i in range(900)}
    assert rows["all"] == rows["different"] > 0


@pytest.mark.parametrize(("block", "hashes"), [(8, 1 << 20), (4096, 1000)])
def test_near_duplicates_in_blocks_and_tiles(spark, monkeypatch, block, hashes):
    texts = _around_one_text(60)
    for at in range(30, 60):
        texts[at] = texts[at - 30 if at % 3 else at - 1] + " more"
    want = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark, documents(spark, texts)).collect()}
    for name, value in (("BLOCK", block), ("MOST_HASHES", hashes), ("TILE", 3)):
        monkeypatch.setattr(neardup, name, value)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark, documents(spark, texts)).collect()} == want
    assert len(set(want.values())) < 60


def test_near_duplicates_of_odd_rows(spark):
    assert neardup.near_duplicates(spark, documents(spark, [])).count() == 0
    rows = spark.createDataFrame([(5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six"), (3, "ONE two three  four five six")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(spark, rows).collect()), key=str)
    assert got == sorted([(5, 2, 3, False), (5, 2, 3, False), (None, 2, None, True), (3, 2, 3, True)], key=str)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.75, 0.95):
        common = rng.integers(0, 2**63, int(4000 * share), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 4000 - len(common), dtype=np.uint64)]) for _ in range(2))
        truth = len(common) / (8000 - len(common))
        got = neardup.estimate((neardup.registers(a) == neardup.registers(b)).mean(), np.array(4000), np.array(4000))
        assert abs(got - truth) < 5 * (truth * (1 - truth) / neardup.REGISTERS) ** 0.5
    # Registers of different sets agree by chance about as often as the correction says.
    pairs = [(neardup.registers(rng.integers(0, 2**63, 50, dtype=np.uint64)), neardup.registers(rng.integers(0, 2**63, 50, dtype=np.uint64))) for _ in range(300)]
    assert np.mean([(x == y).mean() for x, y in pairs]) < 1e-3


def test_components_are_the_graphs(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    want = components_of(461, [(a, b) for a, b in links])
    got = {r["id"]: r["component"] for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}


def test_block_counts_are_set_intersections():
    rng = np.random.default_rng(8)
    a, b = ([np.unique(rng.integers(0, 500, 200, dtype=np.uint64)) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert neardup._common(a, b).tolist() == want


# Vectors


def test_nearest_lattice_points():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 8)) * 2
    near = lattice.nearest_e8(x)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    twice = np.rint(2 * near).astype(int)
    assert (np.abs(2 * near - twice) < 1e-9).all() and ((twice % 2 == twice[:, :1] % 2).all()) and (np.rint(near.sum(1)) % 2 == 0).all()
    around = near[:, None] + lattice.NEIGHBOURS[None]
    assert (((x - near) ** 2).sum(1) <= ((x[:, None] - around) ** 2).sum(2).min(1) + 1e-9).all()


def test_near_vectors_are_brute_force(spark):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((40, 64))
    rows = [b + rng.standard_normal(64) * s for b in base for s in (0.0, 0.05, 0.15, 0.2, 0.22)]
    rows += [rows[0], rows[0], rows[7] * 3]
    lists = [[float(np.float32(v)) for v in r] for r in rows]
    odd = [None, [], [0.0] * 64, [1.0] * 63 + [None], [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(lists + odd)], "vec_id long, embedding array<float>, weight int, side int")
    x = np.array(lists)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    n = len(lists)
    pairs = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j] + [(n + 6, n + 7)]
    want, links = components_of(n + 8, pairs), np.zeros(n + 8, int)
    for i, j in pairs:
        links[[i, j]] += 1
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark, table).collect()}
    assert len(got) == n + 8
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * links.sum()
    assert all(got[i]["n_links"] <= links[i] for i in got)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(n, n + 6))
    assert lattice.near_vectors(spark, table.limit(0)).count() == 0


# Decontamination


def edit_distance_to_part(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_is_dynamic_programming():
    rng = random.Random(11)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 30))
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == edit_distance_to_part(p, t)


def test_items_are_found_within_the_budget(spark):
    rng = random.Random(12)
    items = [words(rng, 20, 10**6) for _ in range(6)]

    def edited(text, n):
        t = list(text)
        for at in rng.sample(range(len(t)), n):
            t[at] = rng.choice(["", "q", t[at] + "q"])
        return "".join(t)

    texts = [*HARD, *(words(rng, 50, 10**6) for _ in range(5))]
    for i, item in enumerate(items):
        texts += [f"{words(rng, 30)} {item.upper()}! {words(rng, 9)}", f"{words(rng, 30)} {edited(item, i)} tail", f"pre {item[: len(item) // 2]}", edited(item, 30)]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "short"), (0, items[0])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(spark, documents(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p = decontaminate.plain(item)
            k = edit_distance_to_part(p, decontaminate.plain(t)) if len(t or "") < 2000 else len(p)
            if k <= int(len(p) * decontaminate.EDIT_SHARE):
                want[d, i] = k
    assert got == want and len(want) >= 11
    kept = decontaminate.clean(spark, documents(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert kept.columns == documents(spark, texts).columns
    assert decontaminate.find_items(spark, documents(spark, []), bench).count() == 0
    assert decontaminate.clean(spark, documents(spark, texts), bench.limit(0)).count() == len(texts)


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(0, "Who is it?"), (1, "日本"), (2, "?!")], "item_id long, text string")
    docs = documents(spark, ["who is it", "(who is, it) then", "who is items", "xwho is it", "古日本語", "who was it"])
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_items(spark, docs, bench).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (4, 1, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(spark, docs, bench).collect()) == [2, 3, 5]


def test_one_rule_for_all_lengths(spark):
    """Items of 1 to 60 characters: whole, with an edit, at the bounds, and inside longer words, against the full distance."""
    rng = random.Random(21)
    items, texts = [], []
    for n in range(1, 61):
        item = "".join(rng.choice("abcdefgh") if i % 6 else rng.choice("mnopqrst") for i in range(n))
        item = "".join(" " if i % 7 == 6 and i < n - 1 else c for i, c in enumerate(item))
        items.append(item)
        at = rng.randrange(n)
        edited = [item[:at] + "z" + item[at + 1 :], item[:at] + item[at + 1 :], item[:at] + "z" + item[at:]]
        texts += [f"uu {x} vv" for x in (item, *edited)] + [item, f"uu x{item} vv", f"uu {item}y vv", f"x{item}y", f"uu {edited[0]}y vv"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts)
    for whole_words in (True, False):
        want = {}
        for i, item in enumerate(items):
            k = int(len(item) * decontaminate.EDIT_SHARE)
            for d in range(9 * max(0, i - 2), 9 * min(60, i + 3)):
                p, t = (f" {item} ", f" {decontaminate.plain(texts[d])} ") if whole_words else (item, decontaminate.plain(texts[d]))
                if (distance := edit_distance_to_part(p, t)) <= k:
                    want[d, i] = distance
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(spark, docs, bench, whole_words=whole_words).collect() if abs(r["doc_id"] // 9 - r["item_id"]) <= 2}
        assert got == want
        assert sum(d > 0 for d in want.values()) > 100


def test_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(13)
    items = [words(rng, 12, 10**6) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, [f"a {x} b" for x in items])
    once = sorted(decontaminate.find_items(spark, docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert sorted(decontaminate.find_items(spark, docs, bench).collect()) == once and len(once) == 9


# Secrets


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.fit(secrets.labelled_samples(spark))


def test_base_spans_are_pythons(spark, ratios):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(14)
    parts = ["password=", "TOKEN : ", 'api_key"="', "secret=", "abcdefgh1", "short", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, " ", "é\U0001f600", "'", "=", "AKIAAKIA", "deadbeef"]
    texts = [*HARD, "token=secret=\"abcdefghijk\"", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400))]
    for r in secrets.digest(documents(spark, texts), ratios).collect():
        t = texts[r["doc_id"]] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        written = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest(), t
        assert [x for x in r["spans"].split(",") if x and not x.startswith("markov")] == written
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in found) for i in range(3)]


def test_models_part_random_from_ordinary(spark, ratios):
    rng = random.Random(15)
    ordinary = ["getElementByIdentifier", "com/example/package/Handler", "application_configuration_manager", "enlichachschlichenbe", "4321567898765432", "the-quick-brown-fox-jumps"]
    rand = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(40)]
    rows = secrets.digest(documents(spark, [f"x {t} y" for t in ordinary + rand]), ratios).orderBy("doc_id").collect()
    assert [r["n_markov"] for r in rows[: len(ordinary)]] == [0] * len(ordinary)
    assert sum(r["n_markov"] for r in rows[len(ordinary) :]) >= 38
    assert secrets.digest(documents(spark, []), ratios).count() == 0


def test_markov_spans_are_recomputed(spark, ratios):
    """The rule in plain Python: the whole run or its best stretch is likelier random."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (15, 16, 20, 24, 40) for _ in range(8)]
    texts = [f"{pre}{k} end" for pre in ("", "see ", "/var/lib/account/settings/", "api/v1/internal/service/") for k in keys] + ["user_account_session_manager", "path/to/the/library/config/file", ""]
    n = len(secrets.ALPHABET)

    def step(a, b):
        return ratios[secrets.ALPHABET.index(a) * n + secrets.ALPHABET.index(b)]

    def hit(run):
        steps = [step(a, b) for a, b in zip(run, run[1:])]
        if sum(steps) >= secrets.LEAST_RATIO and sum(steps) >= secrets.LEAST_MEAN * len(run):
            return True
        best, size, now, chars = 0, 0, 0, 0
        for s in steps:
            now, chars = (now + s, chars + 1) if now > 0 else (s, 2)
            if now > best:
                best, size = now, chars
        return best >= secrets.LEAST_RATIO and size >= secrets.LEAST_CHARS and best >= secrets.LEAST_MEAN * size

    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == 3] for r in secrets.scan(documents(spark, texts), ratios).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [m.span() for m in re.finditer(secrets.CANDIDATE, t) if hit(m[0])], t
    behind = [bool(got[i]) for i, t in enumerate(texts) if t.startswith(("/var", "api")) and len(t.split()[0].rsplit("/", 1)[1]) >= 24]
    assert sum(behind) > 0.9 * len(behind) and not got[len(texts) - 2] and not got[len(texts) - 3]


def test_redaction_hides_all_spans(spark, ratios):
    text = "a password=abcdefgh1 AKIA" + "B" * 16 + " é " + "0123456789abcdef" * 3 + " end"
    found = secrets.scan(documents(spark, [text, None, "clean"]), ratios)
    got = [r[0] for r in found.orderBy("doc_id").select(secrets.redact(F.col("text"), F.col("found"))).collect()]
    assert got == ["a [SECRET] [SECRET] é [SECRET] end", None, "clean"]


# Conversations


def test_only_maximal_conversations_stay(spark):
    turns = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(t)]
    rows = [*turns(1, "a"), *turns(2, "a", "b"), *turns(3, "a", "b", "c"), *turns(4, "a", "x"), *turns(9, "a", "b", "c"), *turns(5, "b", "c"), *turns(6, None), *turns(7, ""), (8, None, None, None), (None, 0, "user", "a"), (4, 0, "user", "a")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, block int")
    got = {r["conv_id"]: r["text"] for r in chat.format_conversations(spark, table).collect()}
    assert sorted(got) == [3, 4, 5, 6, 7, 8]
    assert got[4] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert got[8] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.format_conversations(spark, table.limit(0)).count() == 0


def test_long_conversations_come_in_segments(spark):
    n = 3 * chat.BLOCK + 5
    rows = [(c, i * 3, "user", f"t{i}") for c, k in ((1, n), (2, n - 1)) for i in range(k)]
    got = chat.format_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("segment").collect()
    assert [(r["conv_id"], r["segment"], r["turns"]) for r in got] == [(1, 0, chat.BLOCK), (1, 1, chat.BLOCK), (1, 2, chat.BLOCK), (1, 3, 5)]
    assert "".join(r["text"] for r in got).count("<|im_end|>") == n


# Language, quality, language model


@needs_tables
def test_language_on_held_out_documents(spark, table):
    docs = table("documents")
    got = language.predict_documents(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark):
    content = {"aa": b"the and that this with have from " * 40, "bb": b"der die und nicht ein mit von auch " * 40}
    got = {r["doc_id"]: r for r in language.identify(spark, documents(spark, [*HARD, "12 34 ½ ++", "this and that with the", "der und die nicht mit"]), content, ["doc_id", "part", "_text"]).collect()}
    n = len(HARD)
    assert [got[i]["_lang_pred"] for i in (0, 1, 2, n, n + 1, n + 2)] == ["und", "und", "und", "und", "aa", "bb"]
    assert got[0]["_rejected"] and got[n]["_rejected"] and not got[n + 1]["_rejected"] and got[n + 1]["part"] == "x"
    assert {r["_lang_pred"] for r in language.identify(spark, documents(spark, ["some text"]), {}).collect()} == {"und"}
    assert language.predict_documents(spark, documents(spark, [])).count() == 0


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(16)
    counts = np.array([3, 1, 4])
    unary, trans = rng.standard_normal(8), rng.standard_normal((2, 2))
    p, pairs = quality.forward_backward(unary, counts, trans)
    want, seen = [], np.zeros((2, 2))
    for at, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        labels = np.array(np.meshgrid(*[[0, 1]] * n)).reshape(n, -1).T
        score = labels @ unary[at : at + n] + sum(trans[labels[:, i], labels[:, i + 1]] for i in range(n - 1))
        weight = np.exp(score) / np.exp(score).sum()
        want += (weight @ labels).tolist()
        for i in range(n - 1):
            np.add.at(seen, (labels[:, i], labels[:, i + 1]), weight)
    assert np.allclose(p, want) and np.allclose(pairs, seen)


@needs_tables
def test_quality_on_held_out_documents(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_documents(spark, docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9


def test_quality_of_odd_texts(spark):
    labels = spark.createDataFrame([(0, 1), (9, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    got = quality.score_documents(spark, documents(spark, [*HARD, "line\n" * 3000]), labels).collect()
    assert len(got) == len(HARD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(spark, documents(spark, []), labels.limit(0)).count() == 0


def test_pseudo_likelihood_prefers_what_the_corpus_holds(spark):
    rng = random.Random(17)
    pool = [f" {a}{b}" for a in ("red", "blue", "old", "new") for b in (" house", " river", " stone")]
    corpus = ["".join(rng.choice(pool) for _ in range(60)) for _ in range(150)]
    shuffled = ["".join(rng.sample(corpus[i].split(" "), 100)) for i in range(10)]
    got = {r["doc_id"]: r for r in pseudolm.score(spark, documents(spark, [*HARD, *corpus, *shuffled]).repartition(3)).collect()}
    assert len(got) == len(HARD) + 160
    assert got[0]["n_tokens"] == 0 and got[0]["log_likelihood"] == 0 and got[0]["per_token"] is None
    n = len(HARD)
    assert np.mean([got[i]["per_token"] for i in range(n, n + 150)]) > 1 + np.mean([got[i]["per_token"] for i in range(n + 150, n + 160)])
    assert pseudolm.score(spark, documents(spark, [])).count() == 0


def plain_log_probabilities(net, v, ranks):
    """log P of every rank at the one place whose sides are ``ranks``, by the definition, in doubles."""
    mixing, bias, outputs = (x.astype(np.float64) for x in net.parts())
    h = np.append(np.tanh(sum(net.inputs[r].astype(np.float64) @ m for r, m in zip(ranks, mixing, strict=True)) + bias), 1)
    z = h @ outputs
    first = z - np.log(np.exp(z).sum())
    out = []
    for r in range(v.size):
        k = int(v.of[r])
        z = h @ net.inner[:, v.edges[k] : v.edges[k + 1]].astype(np.float64)
        out.append(first[k] + (z - np.log(np.exp(z).sum()))[r - v.edges[k]])
    return np.array(out)


def test_scores_are_the_networks_conditional_probabilities():
    rng = np.random.default_rng(19)
    v = pseudolm.Vocabulary({i: int(20_000 / (i + 1)) for i in range(0, 600, 2)}, 700)
    net = pseudolm.Network(v)
    docs = [rng.integers(0, 700, n).astype(np.uint16) for n in (0, 1, 2, 5, 60, 0)]
    learner = pseudolm.Learner(net, v, 0, 1)
    for d in docs * 20:
        learner.add(d)
    net = net.mean(learner.sums())
    got = pseudolm.document_scores(net, v, docs)
    for d, value in zip(docs, got, strict=True):
        r = [v.size, v.size, *v.rank[d].tolist(), v.size, v.size]
        every = [plain_log_probabilities(net, v, [r[i - 2], r[i - 1], r[i + 1], r[i + 2]]) for i in range(2, len(r) - 2)]
        assert all(abs(np.exp(e).sum() - 1) < 1e-9 for e in every)
        assert abs(value - sum(e[t] for e, t in zip(every, r[2:-2], strict=True))) < 1e-3 * (len(d) + 1)


def test_slopes_are_differences(monkeypatch):
    """A step with equal squares moves along the slope of the summed logarithms."""
    rng = np.random.default_rng(5)
    v = pseudolm.Vocabulary({i: 900 - i for i in range(300)}, 300)
    net = pseudolm.Network(v)
    for x in (net.dense, net.inputs, net.inner):
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.3
    seq = pseudolm.strung([rng.integers(0, 40, 50).astype(np.uint16)], v)
    moved = net.copy()
    for x in (moved.dense_squares, *moved.squares):
        x[:] = 1e12
    pseudolm.window_logs(moved, v, seq, learn=1e5)
    for name in ("dense", "inputs", "inner"):
        x, step = getattr(net, name), (getattr(moved, name) - getattr(net, name)) * 10.0
        for at in zip(*np.nonzero(np.abs(step) > 0.5 * np.abs(step).max()), strict=True):
            before = x[at]
            x[at] = before + 0.02
            up = pseudolm.window_logs(net, v, seq).sum(dtype=np.float64)
            x[at] = before - 0.02
            down = pseudolm.window_logs(net, v, seq).sum(dtype=np.float64)
            x[at] = before
            assert (up - down) / 0.04 == pytest.approx(step[at], rel=0.05, abs=0.05)


def test_rounds_train_on_every_position_once(monkeypatch):
    monkeypatch.setattr(pseudolm, "STEP_TOKENS", 64)
    v = pseudolm.Vocabulary({1: 5, 7: 2, 300: 9}, 500)
    seen, real = [], pseudolm.window_logs
    monkeypatch.setattr(pseudolm, "window_logs", lambda n, w, seq, learn=0.0: (seen.append(seq.copy()), real(n, w, seq, learn))[1])
    docs = [np.arange(n, dtype=np.uint16) % 500 for n in (0, 1, 63, 64, 65, 2000, 3)]
    for rounds in (1, 2, 3):
        seen.clear()
        total = 0
        for turn in range(rounds):
            learner = pseudolm.Learner(pseudolm.Network(v), v, turn, rounds)
            for d in docs:
                learner.add(d)
            learner.sums()
            total += learner.seen
        inner = np.concatenate([x[2:-2] for x in seen])
        assert total == sum(map(len, docs)) == (inner < v.size).sum()
        want = Counter(v.rank[np.concatenate(docs)].tolist())
        assert Counter(inner[inner < v.size].tolist()) == want


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "SHARD_BYTES", 4000)
    rng = random.Random(23)
    docs = documents(spark, [*HARD, *(words(rng, 60, 30) for _ in range(60))])
    one, other = ({r["doc_id"]: r["log_likelihood"] for r in pseudolm.score(spark, d).collect()} for d in (docs.repartition(1), docs.repartition(7, "text")))
    assert one.keys() == other.keys()
    assert all(other[k] == pytest.approx(x, rel=1e-3, abs=1e-2) for k, x in one.items())


# Ids, long texts, repeated rows, clashing columns

FAR = 1 << 60


def test_ids_beside_null_ids_stay_whole(spark):
    ids = [FAR + 1, None, FAR + 3, FAR + 5, FAR + 5]
    texts = ["a text with some words in it", None, "another text with some other words", "x" * 300_000 + " y", "x" * 300_000 + " y"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "e") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, score long, ids string").coalesce(1)
    labels = spark.createDataFrame([(FAR + 1, 1, 0), (FAR + 3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(FAR + 7, "some other words"), (None, "some words in it")], "item_id long, text string")
    got = {
        "op1": packing.pack(spark, docs).where("piece = 0"), "op2": neardup.near_duplicates(spark, docs), "op3": quality.score_documents(spark, docs, labels),
        "op4": pseudolm.score(spark, docs), "op7": secrets.digest(docs, secrets.fit(secrets.labelled_samples(spark))), "op9": language.predict_documents(spark, docs), "op10": rollups.count_tokens(spark, docs),
    }
    for name, df in got.items():
        assert Counter(r["doc_id"] for r in df.collect()) == Counter(ids), name
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(spark, docs, bench).collect()} == {(FAR + 1, None), (FAR + 3, FAR + 7)}
    assert {r["doc_id"] for r in decontaminate.clean(spark, docs, bench).collect()} == {None, FAR + 5}


def test_very_long_texts_are_read_whole(spark):
    rng = random.Random(41)
    body = words(rng, 300_000, 5000)
    item = "a passage of the benchmark that stands near the very end of a text that is long"
    docs = spark.createDataFrame([(1, f"{body} {item} password = 'Zx81Qp0vNm44' tail", "en"), (2, f"{body} {item} password = 'Zx81Qp0vNm44' tail other", "en"), (3, body[: len(body) // 2], "en")], "doc_id long, text string, lang string")
    pieces = packing.pack(spark, docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    whole = tokens.encoder().tokenizer
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n"] for r in pieces} == {k: len(whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    near = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(spark, docs).collect()}
    assert near[2] == (1, near[1][1] + 1) and near[3][0] == 3
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_items(spark, docs, bench).collect()} == {1, 2}
    spans = {r["doc_id"]: r["n_assign"] for r in secrets.digest(docs, secrets.fit(secrets.labelled_samples(spark))).collect()}
    assert spans == {1: 1, 2: 1, 3: 0}
    assert all(r["n_tokens"] > 500_000 for r in pseudolm.score(spark, docs).where("doc_id < 3").collect())
    assert language.predict_documents(spark, docs).count() == quality.score_documents(spark, docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 3


def test_ties_have_one_answer(spark):
    docs = documents(spark, ["some text", "some text", "other words here"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality.score_documents(spark, docs, none).collect()} == {(0.5, 1)}
    lang, score, rejected, low, after = language.Classifier({"b": b"same words " * 9, "a": b"same words " * 9}).predict("same words again")
    assert (lang, rejected, low == after) == ("a", True, True) and score == pytest.approx(0.5)
    sizes = language.Classifier({"b": b"same words " * 9, "a": b"quite another " * 9})
    import zstandard

    for text in ("same words", "quite another one", "Some MORE, same!"):
        data = language.plain(text).encode()
        want = []
        for content in (b"quite another " * 9, b"same words " * 9):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            want.append(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress(data)))
        got = sizes.predict(text)
        assert sizes.sizes(text) == want and got[0] == ("a" if want[0] <= want[1] else "b") and (got[3], got[4]) == (min(want), max(want))


def test_quality_scores_are_recomputed(spark):
    """The score of a text from the model's weights, with the marginals of all labellings added up."""
    rng = random.Random(43)
    texts = [*(words(rng, 12).replace(" ", "\n", 2) for _ in range(20)), *("!!! ### $$$\n|| ||" for _ in range(20))]
    model = quality.train(texts, [1] * 20 + [0] * 20, 30)
    for text in ("one two\nthree !!!\n###", "", "a", texts[0], texts[-1]):
        own, size, counts = quality.line_features([text])
        unary = quality.with_neighbours(own, counts) @ model.weights
        n = int(counts[0])
        good, total = np.zeros(n), 0.0
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(np.clip(unary[i], -30, 30) * y[i] for i in range(n)) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        share = np.clip((good / total * size).sum() / size.sum(), 1e-4, 1 - 1e-4)
        want = 1 / (1 + np.exp(-(model.curve[0] * np.log(share / (1 - share)) + model.curve[1])))
        assert model.scores([text])[0] == pytest.approx(want, abs=1e-6), text


def test_vectors_with_null_and_repeated_ids(spark):
    rows = [(FAR + 1, [1.0, 2.0]), (None, [1.0, 2.0]), (FAR + 3, [1.0, 2.0]), (FAR + 3, [2.0, 4.1]), (FAR + 5, None)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_vectors(spark, spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cells int")).collect()), key=str)
    assert got == sorted([(FAR + 1, 2, FAR + 1), (None, 0, None), (FAR + 3, 2, FAR + 1), (FAR + 3, 2, FAR + 1), (FAR + 5, 0, FAR + 5)], key=str)


# Token rollups


def direct_totals(spark, texts):
    whole, out = tokens.encoder().tokenizer, Counter()
    seen = set()
    for t in texts:
        if t is not None and t in seen:
            continue
        seen.add(t)
        for version, n in (("words/1", len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))), ("byte_bpe_50k/1", len(whole.encode(t or "", add_special_tokens=False).ids))):
            out[version, "docs"] += 1
            out[version, "tokens"] += n
    return out


def test_rollups_are_direct_counts(spark, tmp_path):
    rng = random.Random(18)
    texts = [*(t for t in HARD if t is not None), None, *(words(rng, 50) for _ in range(20)), "same text"]
    got = Counter()
    for r in rollups.roll_up_documents(spark, documents(spark, texts), f"file://{tmp_path}/r").collect():
        got[r["tokenizer_version"], "docs"] += r["docs"]
        got[r["tokenizer_version"], "tokens"] += r["tokens"]
    assert got == direct_totals(spark, texts)
    assert rollups.roll_up_documents(spark, documents(spark, []), f"file://{tmp_path}/e").count() == 0


def test_registered_totals_are_of_all_documents(spark, tmp_path):
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([("same text", "a"), ("same text", "b"), ("same text", "b"), ("one more", "b"), (None, "c"), (None, "c")])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["source"], r["docs"], r["tokens"]) for r in registry.op10_token_rollup(spark, str(tmp_path)).where("tokenizer_version = 'words/1'").collect()}
    assert got == {("a", 1, 2), ("b", 3, 6), ("c", 2, 0)}


def test_batches_count_once(spark, tmp_path):
    t = rollups.TokenRollup(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("a", None, "v1", 5, 3), (None, "en", "v1", None, 0)], "source string, lang string, tokenizer_version string, tokens long, old_tokens long")
    assert t.totals().count() == 0
    assert t.commit("one", rollups.inserts(rows)) and not t.commit("one", rollups.inserts(rows))
    assert t.commit("two", rollups.revisions(rows))
    want = sorted([("a", None, "v1", 1, 7), (None, "en", "v1", 1, 0)], key=str)
    assert sorted(map(tuple, t.totals().collect()), key=str) == want
    t.compact()
    assert sorted(map(tuple, t.totals().collect()), key=str) == want
    assert not t.commit("two", rollups.revisions(rows)) and t.batches() == ["one", "two"]
    assert t.commit("three", rollups.deletes(rows)) and t.commit("four", rollups.revisions(rows.selectExpr("source", "lang", "tokenizer_version", "0L as tokens", "if(source = 'a', 2L, 0L) as old_tokens")))
    assert t.totals().count() == 0


# Queries


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_with_oracles(spark, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.ORACLES[name]) == ""


def linked_components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_ids_that_repeat_with_other_texts(spark):
    """30 groups: one id with two texts, near copies of each; and near copies under one id, equal texts under two, null ids."""
    rng = random.Random(31)

    def near(text):
        w = text.split()
        w[rng.randrange(len(w))] = "other"
        return " ".join(w)

    rows = []
    for g in range(30):
        a, b = words(rng, 60), words(rng, 60)
        rows += [(10 * g + 1, a), (10 * g + 1, b), (10 * g + 2, near(a)), (10 * g + 3, near(b)), (10 * g + 4, words(rng, 60)), (None, a)]
        rows += [(10 * g + 5, b), (10 * g + 6, (c := words(rng, 60))), (10 * g + 6, near(c)), (10 * g + 6, None), (10 * g + 7, near(c))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, "y") for i, t in rows], DOCS).repartition(3)
    sets = [set(neardup.shingles(neardup.word_hashes(t or "")).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and (
        rows[i][0] == rows[j][0] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))]
    of = linked_components(len(rows), links)
    least = {c: min((rows[i][0] for i in range(len(rows)) if of[i] == c and rows[i][0] is not None), default=None) for c in set(of)}
    want = sorted(((d, len(sets[i]), least[of[i]] if d is not None else None, d is None or least[of[i]] == d) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, neardup.near_duplicates(spark, docs).collect()), key=str) == want


def test_vector_ids_that_repeat_with_other_vectors(spark):
    rng = np.random.default_rng(32)
    rows = []
    for g in range(12):
        basis = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        turn = lambda t, basis=basis: (np.cos(t) * basis[0] + np.sin(t) * basis[1]).tolist()
        rows += [(10 * g + 1, turn(0)), (10 * g + 1, turn(0.1)), (10 * g + 2, turn(0.05)), (10 * g + 3, turn(2)), (10 * g + 1, turn(2.02)), (10 * g + 4, turn(0)), (None, turn(0))]
    units = np.array([v for _, v in rows], np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and units[i] @ units[j] >= 0.95]
    of = linked_components(len(rows), links)
    counts = Counter(x for pair in links for x in pair)
    least = {c: min(rows[i][0] for i in range(len(rows)) if of[i] == c and rows[i][0] is not None) for c in set(of) if any(of[i] == c and rows[i][0] is not None for i in range(len(rows)))}
    want = sorted(((d, counts[i], None if d is None else least[of[i]]) for i, (d, _) in enumerate(rows)), key=str)
    got = lattice.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("rows", [10**5, 10**7, 10**9])
def test_cells_let_near_vectors_meet_at_all_sizes(rows):
    tables, scale = lattice.layout(rows)
    rng = np.random.default_rng(33)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 600, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b *= np.sqrt(1 - lattice.COSINE**2) / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (lattice.cells(v, tables, lattice.PROBES, scale) for v in (a, lattice.COSINE * a + b))
    assert ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1).mean() >= 0.98


def test_ids_of_a_column_are_those_of_its_texts():
    rng = random.Random(29)
    odd = [None, "", " ", "  a", "a  b", "a  b", "a ᠎b", "a \x1cb", "<|endoftext|> a", "a\0 b", " lead", "trail ", "a \n", "\n\n", "don't we'LL z", "日本 é_b", "x" * 100 + " y"]
    texts = [*odd, *("".join(rng.choices("ab1 \n\té日'-\0", k=30)) for _ in range(200)), *(" ".join(rng.choices(["ab", "don't", "é\n", "日本"], k=9)) for _ in range(200))]
    encoder = tokens.Encoder(tokens.DEFAULT_VOCAB)
    for some in (texts, texts[-200:], [], [None]):
        ids, ends = encoder.column(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
    assert [x.tolist() for x in encoder.column(pa.array(["no", "a b", "c"]).slice(1, 2))] == [x.tolist() for x in encoder.column(pa.array(["a b", "c"]))]
