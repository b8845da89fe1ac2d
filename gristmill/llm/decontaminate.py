"""Benchmark decontamination by pigeonhole edit matching.

An item within ``k`` edits of a stretch of text, cut into ``k + 1`` pieces,
has a piece that stands there unchanged. An Aho-Corasick automaton finds the
pieces of all items in a text; where one is hit, Myers' bit-parallel distance
decides over the stretch that the whole item could cover.

Items and texts are compared in lower case, with one space for each run of
other characters than letters and digits, and one before and after all. An
item is looked for with the spaces around it, so it is held as whole words:
to stand inside a longer word costs it an edit on that side. The budget is a
share of the item's characters; short items have none and are found exactly.
Scripts that put no spaces between words have no bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.05
#: Items go to the executors in blocks of about so many characters; each block is a pass.
BLOCK_CHARS = 4_000_000

BETWEEN = re.compile(r"[\W_]+")
#: Scripts that put no spaces between words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
OUTPUT = "doc_id long, item_id long, distance int, start int, end int, item_chars int"


def plain(text: str | None) -> str:
    return BETWEEN.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(place, piece) of ``budget + 1`` pieces of almost equal length."""
    edges = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def bounded(item: str) -> str:
    """The plain item with a space on each side where its script has bounds between words."""
    return (" " * (not UNSPACED.match(item[0]))) + item + (" " * (not UNSPACED.match(item[-1])))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(least distance of the pattern to a part of the text, the first end with it), end exclusive.

    ``anchored``: the part starts where the text does.
    """
    full, high, carry = (1 << m) - 1, 1 << (m - 1), int(anchored)
    pv, mv, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best[0]:
                best = (score, at)
        ph = (ph << 1 | carry) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """Finds items in texts; made once for a task."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE, whole_words: bool = True):
        self.items, self.sizes, self.budgets, self.masks = [], [], [], {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            n = len(self.items)
            self.sizes.append(len(text))
            self.budgets.append(int(len(text) * share))
            text = bounded(text) if whole_words else text
            self.items.append((item_id, text))
            for at, piece in pieces(text, self.budgets[-1]):
                found.setdefault(piece, []).append((n, at + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, end, item's characters) of each item that the text holds; its best place.

        Places are in the plain text, without the spaces around the item.
        """
        if not self.items:
            return []
        text = f" {plain(text)} "
        starts: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for n, last in where:
                starts.setdefault(n, set()).add(end - last)
        out = []
        for n, at in sorted(starts.items()):
            item_id, item = self.items[n]
            exact = text.find(item)
            best = (0, exact, exact + len(item)) if exact >= 0 else self.budgets[n] and self.verify(n, sorted(at), text)
            if best:
                distance, start, end = best
                part = text[start:end]
                start, end = start + len(part) - len(part.lstrip()), end - len(part) + len(part.rstrip())
                out.append((item_id, distance, start - 1, end - 1, self.sizes[n]))
        return out

    def verify(self, n: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        item, k = self.items[n][1], self.budgets[n]
        m = len(item)
        if n not in self.masks:
            self.masks[n] = masks(item), masks(item[::-1])
        forward, backward = self.masks[n]
        windows: list[list[int]] = []
        for s in starts:
            a, b = max(0, s - k), min(len(text), s + m + k)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([a, b])
        best = None
        for a, b in windows:
            distance, end = myers(forward, m, text[a:b])
            if distance <= k and (best is None or distance < best[0]):
                _, length = myers(backward, m, text[max(0, a + end - m - k) : a + end][::-1], anchored=True)
                best = (distance, a + end - length, a + end)
        return best


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The different rows of ``benchmark`` in blocks of about ``BLOCK_CHARS`` characters, chosen by hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_CHARS))
    for block in range(blocks):
        of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        yield [(r["item_id"], r["text"]) for r in items.where(of).collect()]


def find_items(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, whole_words: bool = True) -> DataFrame:
    """doc_id, item_id, distance, start, end and item_chars for each document row and each item that it holds.

    Places are in the plain text, and the distance is that of the item with the spaces around it; without
    ``whole_words`` it is that of the item alone, wherever it stands. Null and empty texts hold nothing, nor
    do items without letters and digits stand anywhere; an item that stands in several rows of ``benchmark`` is
    looked for once. An empty table of documents or items gives no rows. Other columns are ignored.
    """
    shared.text_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)

    def one_pass(held: list[tuple[int, str]]) -> DataFrame:
        def search(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
            matcher = Matcher(held, share, whole_words)
            names = [f.split()[0] for f in OUTPUT.split(",")]
            for batch in batches:
                rows = [(d, *found) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for found in matcher.search(t)]
                yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return shared.map_columns(source, search, OUTPUT)

    return reduce(DataFrame.unionByName, map(one_pass, item_blocks(benchmark)))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, whole_words: bool = True) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns.

    Null and empty texts hold none and stay, as do rows without doc_id; repeated rows stay or go together; an
    empty ``benchmark`` keeps all. The rule is that of ``find_items``.
    """
    shared.text_batches(spark)

    def one_pass(rows: DataFrame, held: list[tuple[int, str]]) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held, share, whole_words)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        return rows.mapInArrow(keep, rows.schema)

    return reduce(one_pass, item_blocks(benchmark), docs)
