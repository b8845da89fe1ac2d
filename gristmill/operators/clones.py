"""Passages that files share, found by winnowed token fingerprints.

A clone is a run of at least ``TOKENS`` equal tokens. Of all fingerprints of
``SEED`` tokens in a window of ``TOKENS`` the least one is its seed, so equal
windows have equal seeds, and windows in a row mostly have the same one: a
file becomes a row for each change of seed, a segment. Segments of equal
tokens form a class, and a class is looked at once, however many copies there
are: only where a seed has several classes are their windows compared one by
one. Each window is taken to its first place in the order of files, and the
windows that follow each other there and here are put together to runs that
cannot be longer. What is listed is linear in the texts, and never all pairs.

It approximates the report of a clone detector whose own tokens depend on the
language; here a token is a word or another character that is no space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.ordering import saved

TOKEN = r"\w+|[^\w\s]|\n"
#: Tokens of the shortest clone, and of a fingerprint.
TOKENS, SEED = 70, 24
#: A key is hot if it has more than one of so many rows, so there are fewer hot keys than that; and a hot key's parts in a shuffle.
HOT, PARTS = 1000, 64
#: Characters that a task reads at a time.
CHARS = 2_000_000
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
CLASS = ["c1", "c2"]
LINES = T.ArrayType(T.StructType().add("o", "integer").add("line", "integer"))


def read_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line and text's number of each token of all texts."""
    words, size = [], []
    for text in texts:
        found = re.findall(TOKEN, text)
        words += found
        size.append(len(found))
    number, values = pd.factorize(np.array(words, dtype=object))
    hashes = pd.util.hash_array(np.asarray(values, dtype=object), categorize=False) if len(values) else np.zeros(0, np.uint64)
    ends = values[number] == "\n" if len(values) else np.zeros(0, bool)
    seen = np.concatenate([[0], np.cumsum(ends)])
    size = np.array(size, np.int64)
    line = 1 + seen[1:] - np.repeat(seen[np.cumsum(size) - size], size)
    return hashes[number][~ends], line[~ends].astype(np.int32), np.repeat(np.arange(len(texts)), size)[~ends]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of batches and their texts, in parts of some CHARS characters or one longer text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        cut = [0, *(np.flatnonzero(np.diff(np.cumsum([len(x) for x in texts]) // CHARS)) + 1), len(texts)]
        for a, b in zip(cut, cut[1:]):
            if b > a:
                yield batch.slice(a, b - a), texts[a:b]


class Rolling:
    """Hash of every stretch of a sequence modulo 2**64: the same tokens give the same hash, wherever they stand."""

    def __init__(self, codes: np.ndarray, base: int):
        powers = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(codes), b, np.uint64))])
        self._back = powers(pow(base, -1, 2**64))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(base)[:-1])])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return ((self._sums[start + length] - self._sums[start]) * self._back[start]).view(np.int64)


def least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each ``size`` values in a row, in linear time: of a block's end and the next one's start."""
    n = len(values)
    filled = np.full(-(-n // size) * size, np.iinfo(values.dtype).max, values.dtype)
    filled[:n] = values
    blocks = filled.reshape(-1, size)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], fore[size - 1 : n])


def repeated(seeds: np.ndarray, least: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the least of a segment's seeds stands in it more than once."""
    # Only what is the least of a window around it can be; the rest is not sorted.
    width = TOKENS - SEED + 1
    low = np.full(width - 1, np.iinfo(np.int64).max)
    around = ~least_in_windows(~np.concatenate([~low, least, ~low]), width)
    places = np.flatnonzero(seeds == around)
    values, number = np.unique(seeds[places], return_inverse=True)
    wide = len(seeds) + 1
    places = np.sort(number * wide + places)
    own = np.searchsorted(values, least[at]) * wide + at
    return np.searchsorted(places, own + size) - np.searchsorted(places, own) > 1


def segments_of(texts: list[str]) -> dict[str, np.ndarray] | None:
    """Runs of a text's windows with one seed: seed, two hashes of their tokens, first window, windows, and the lines in them."""
    codes, line, doc = read_tokens(texts)
    if len(codes) < TOKENS:
        return None
    one, two = (Rolling(codes, b) for b in BASES)
    seeds = one(np.arange(len(codes) - SEED + 1), SEED)
    least = least_in_windows(seeds, TOKENS - SEED + 1)
    # A window over two texts is none, and ends a segment.
    inside = doc[: len(least)] == doc[TOKENS - 1 :]
    new = np.concatenate([[True], (np.diff(least) != 0) | (np.diff(doc[: len(least)]) != 0) | (np.diff(inside.astype(np.int8)) != 0)])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(least)]]))
    at, n = at[inside[at]], n[inside[at]]
    size = n + TOKENS - 1
    # Whether a segment has its seed in several places, so that its own windows may be equal.
    again = repeated(seeds, least, at, size - SEED + 1)
    breaks = np.flatnonzero(np.diff(line)) + 1
    lo, hi = np.searchsorted(breaks, at, "right"), np.searchsorted(breaks, at + size)
    # The segment's first token, and the first tokens of the lines that begin in it.
    count = hi - lo + 1
    first = np.cumsum(count) - count
    token = np.concatenate([breaks, [0]])[np.repeat(lo - first - 1, count) + np.arange(count.sum())]
    token[first] = at
    own = doc[at]
    return {"doc": own, "seed": least[at], "c1": one(at, size), "c2": two(at, size), "n": n, "again": again, "at": at - np.searchsorted(doc, own), "count": count, "o": token - np.repeat(at, count), "line": line[token]}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _chunks(batches):
        found = segments_of(texts)
        if found is None or not len(found["at"]):
            continue
        ends = np.concatenate([[0], np.cumsum(found["count"])]).astype(np.int32)
        lines = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int32)) for c in ("o", "line")], ["o", "line"])
        columns = [batch.column("doc").take(pa.array(found["doc"])), *(pa.array(found[c]) for c in ("seed", "c1", "c2")), *(pa.array(found[c].astype(np.int32)) for c in ("n", "again", "at")), pa.ListArray.from_arrays(pa.array(ends), lines)]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "seed", *CLASS, "n", "again", "at", "lines"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _chunks(batches):
        codes, line, doc = read_tokens(texts)
        listed = batch.column("parts")
        row = np.repeat(np.arange(len(texts)), listed.value_lengths().to_numpy())
        part = {c: listed.flatten().field(c).to_numpy() for c in (*CLASS, "n", "at", "copied")}
        n = part["n"]
        own = np.repeat(np.arange(len(n)), n)
        o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = part["at"][own] + o
        here = pos + np.searchsorted(doc, row)[own]
        ints = [pa.array(x.astype(np.int32)) for x in (part["copied"][own], o, pos, line[here], line[here + TOKENS - 1])]
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row[own])), *(pa.array(Rolling(codes, b)(here, TOKENS)) for b in BASES), *(pa.array(part[c][own]) for c in CLASS), *ints], ["doc", "h1", "h2", *CLASS, "copied", "o", "pos", "la", "lb"])


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], by: list[str], counts: DataFrame) -> DataFrame:
    """Inner join of rows with ``few``, which has each key a few times; rows of hot keys by ``counts`` (keys, n) are dealt by a hash of ``by``."""
    all_rows = counts.agg(F.sum("n").alias("n")).scalar()
    # Fewer than HOT rows.
    hot = F.broadcast(counts.where(F.col("n") * HOT > all_rows).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    parts = F.when(F.col("_hot"), F.sequence(zero, F.lit(PARTS - 1).cast("long"))).otherwise(F.array(zero))
    every = few.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return rows.join(hot, keys, "left").withColumn("_part", part).drop("_hot").join(every, [*keys, "_part"]).drop("_part")


def _line_at(o: Column) -> Column:
    return F.element_at(F.filter("lines", lambda x: x["o"] <= o), -1)["line"]


def _joined(rows: DataFrame, group: list[str], pos: str, size: Column) -> DataFrame:
    """``rows`` with ``_run``: one number for those of a group that follow each other without a gap."""
    w = Window.partitionBy(*group).orderBy(pos)
    gap = F.coalesce((F.col(pos) > F.lag(F.col(pos) + size).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w)).drop("_gap")


def found_clones(files: DataFrame) -> DataFrame:
    """ord, lines, tokens, a, b (STRUCT<file, start, end>) of files (file, text): passages ``b`` that stand first in ``a``.

    Every window of at least ``TOKENS`` tokens that stands in several places belongs to a clone in each place but the
    first, by file, text's hash and position; lines count from 1 and ``lines`` is the length of ``b``. Clones are as
    long as they can be with one first place. A window that overlaps its own first place is none. Null texts, texts
    that are too short and an empty table have no clones; rows with the same file and text count once; a null file is
    a file and comes first; rows of one file with different texts are different files of one name. Other columns are
    ignored. A text of any length is one row, and so one task's work, and is never all compared with another.
    """
    doc = F.struct(F.col("file"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).alias("doc")
    texts = files.where("text is not null").select(doc, "text")
    typed = lambda names: T.StructType([texts.schema["doc"], *(T.StructField(c, T.LongType() if c in ("seed", "c1", "c2", "h1", "h2") else T.IntegerType()) for c in names)])
    segments = saved(texts.mapInArrow(_segments, typed(["seed", *CLASS, "n", "again", "at"]).add("lines", LINES)))

    # Seeds that stand once are done with here: most of them, so nothing else is shuffled for them twice.
    seeds = segments.groupBy("seed").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again = 1")
    kept = saved(seeds.select("seed", "n"))
    held = saved(_salted(segments, kept.select("seed"), ["seed"], ["doc", "at"], kept))

    # A class, its first place, and how many classes its seed has.
    place = F.struct("doc", "at", _line_at(F.lit(0)).alias("la"), _line_at(F.col("n") + F.lit(TOKENS - 2)).alias("lb"))
    classes = saved(held.groupBy("seed", *CLASS, "n", "again").agg(F.min(place).alias("first"), F.count("*").alias("places")))
    several = classes.groupBy("seed").agg(F.count("*").alias("n"), (F.count("*") + F.max("again")).alias("classes"))
    met = saved(_salted(classes, several.select("seed", "classes"), ["seed"], CLASS, several.select("seed", "n")))
    whole = met.where("classes = 1").select(*CLASS, F.lit(0).alias("o"), F.col("n").alias("size"), F.col("first.doc").alias("of"), F.col("first.at").alias("pos"), "first.la", "first.lb")

    # Where classes share a seed, the windows of each meet; a class's windows are those of its first place.
    parts = met.where("classes > 1").groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct(*CLASS, "n", F.col("first.at").alias("at"), (F.col("places") > 1).cast("int").alias("copied"))).alias("parts"))
    windows = saved(texts.join(parts, "doc").mapInArrow(_windows, typed(["h1", "h2", *CLASS, "copied", "o", "pos", "la", "lb"])))
    firsts = saved(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos", "la", "lb")).alias("f"), F.count("*").alias("n"), F.max("copied").alias("copied")).where("n > 1 or copied = 1").drop("copied"))
    taken = _salted(windows.select("h1", "h2", *CLASS, "o"), firsts.drop("n"), ["h1", "h2"], [*CLASS, "o"], firsts.select("h1", "h2", "n"))
    taken = taken.select(*CLASS, "o", F.col("f.doc").alias("of"), F.col("f.pos").alias("pos"), F.col("f.la").alias("la"), F.col("f.lb").alias("lb")).withColumn("way", F.col("o") - F.col("pos"))
    runs = _joined(taken, [*CLASS, "of", "way"], "o", F.lit(1)).groupBy(*CLASS, "of", "way", "_run")
    runs = runs.agg(F.min("o").alias("o"), (F.max("o") - F.min("o") + 1).alias("size"), F.min("pos").alias("pos"), F.min("la").alias("la"), F.max("lb").alias("lb"))

    # Every place of a class, and its runs put together over the segments of a file.
    known = whole.unionByName(runs.drop("way", "_run")).withColumnRenamed("pos", "to")
    here = _salted(held.select("doc", *CLASS, "at", "lines"), known, CLASS, ["doc", "at"], classes.select(*CLASS, F.col("places").alias("n")))
    start, end = F.col("o"), F.col("o") + F.col("size") + F.lit(TOKENS - 2)
    here = here.select("doc", (F.col("at") + start).alias("pos"), "size", "of", "to", _line_at(start).alias("a"), _line_at(end).alias("b"), "la", "lb")
    here = here.withColumn("way", F.col("pos") - F.col("to")).where((F.col("doc") != F.col("of")) | (F.col("way") >= TOKENS)).distinct()
    long = _joined(here, ["doc", "of", "way"], "pos", F.col("size")).groupBy("doc", "of", "way", "_run")
    long = long.agg((F.sum("size") + F.lit(TOKENS - 1)).cast("int").alias("tokens"), F.min("pos").alias("pos"), *(f(c).alias(c) for c, f in (("a", F.min), ("b", F.max), ("la", F.min), ("lb", F.max))))
    side = lambda f, a, b: F.struct(F.col(f).alias("file"), F.col(a).alias("start"), F.col(b).alias("end"))
    return long.select(F.struct("doc", "pos", "of", "way").alias("ord"), (F.col("b") - F.col("a") + 1).alias("lines"), "tokens", side("of.file", "la", "lb").alias("a"), side("doc.file", "a", "b").alias("b"))
