"""Near-duplicate documents by HyperMinHash sketches.

A document is its set of shingles, five words each. Of each of ``REGISTERS``
hash functions the least value over the set is kept in 16 bits, as its count
of leading zeros and the mantissa bits after them. Bands of registers that
agree make candidates; the share of agreeing registers, corrected for those
that agree by chance, estimates the Jaccard similarity of a candidate pair,
and pairs over a lower bound are confirmed on their full sets.

Documents with equal word sequences are one class from the start. In each
bucket all are first compared with its least document. Then, in buckets whose
documents are still in different components, all pairs across components are
compared and confirmed inside tasks, which get a bucket whole or, where it is
large, two blocks of it, and only links that join components leave the tasks. So every candidate pair is looked at unless its
documents are connected already; no bucket is cut short, and no task returns
all pairs of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

WORDS = 5
REGISTERS, ROWS_OF_BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS_OF_BAND
SIMILARITY = 75  # hundredths
#: Candidates with a lower estimate are not confirmed: four standard deviations under the similarity.
LEAST_ESTIMATE = 0.60
#: Documents of a bucket in a block that goes to tasks, and hashes of their sets (8 bytes each); a row goes out once for each block it meets.
BLOCK, MOST_HASHES = 4096, 1 << 20
#: Documents of a block that are compared at once, and partners of a leader in a part.
TILE, PART = 256, 100
#: Bits of the filter that keeps other texts out of a shuffle.
MOST_BITS = 1 << 27
SKETCH = "doc_id long, n_shingles long, key1 long, key2 long, regs binary, bands array<long>"

_random = np.random.default_rng(20240229)
_ONE = np.uint64(1)
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
STEPS = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + _ONE
FACTORS = _random.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + _ONE
TERMS = _random.integers(0, 2**63, REGISTERS, dtype=np.uint64)
BAND_STEPS = _random.integers(1, 2**63, ROWS_OF_BAND, dtype=np.uint64) * np.uint64(2) + _ONE
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: runs of other bytes than ASCII white space, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = SPACE[raw]
    inside = np.flatnonzero(~gap)
    if not len(inside):
        return np.empty(0, np.uint64)
    fresh = np.empty(len(inside), bool)
    fresh[0] = True
    np.not_equal(np.diff(inside), 1, out=fresh[1:])
    begins = np.flatnonzero(fresh)
    lengths = np.diff(np.append(begins, len(inside)))
    place = np.arange(len(inside)) - np.repeat(begins, lengths)
    if len(begins) and lengths.max() > len(POWERS):
        powers = np.cumprod(np.full(int(lengths.max()), POWERS[0], np.uint64), dtype=np.uint64)
    else:
        powers = POWERS
    terms = mix(LOWER[raw[inside]].astype(np.uint64) + _ONE) * powers[place]
    return mix(np.add.reduceat(terms, begins) + lengths.astype(np.uint64))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        return mix((words * STEPS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for j in range(WORDS):
        total += words[j : n - WORDS + 1 + j] * STEPS[j]
    return np.unique(mix(total + np.uint64(WORDS)))


def sequence_key(words: np.ndarray) -> tuple[int, int]:
    """128 bits that tell word sequences apart."""
    n = np.arange(1, len(words) + 1, dtype=np.uint64)
    a = mix((mix(words ^ mix(n)).sum(dtype=np.uint64) + n[-1:]))
    b = mix((mix(words + mix(n * np.uint64(0xD6E8FEB86659FD93))).sum(dtype=np.uint64) ^ n[-1:]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def registers(values: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set, 16 bits each."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        np.minimum(least, (values[at : at + 2048, None] * FACTORS + TERMS).min(0), out=least)
    zeros = np.zeros(REGISTERS, np.uint64)
    x = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (_ONE << np.uint64(64 - step))
        zeros[low] += np.uint64(step)
        x[low] <<= np.uint64(step)
    zeros = np.minimum(zeros, np.uint64(63))
    return ((zeros << np.uint64(MANTISSA)) | ((x << _ONE) >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.reshape(BANDS, ROWS_OF_BAND).astype(np.uint64) + _ONE
    return mix((mix(parts) * BAND_STEPS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of registers that agree, and the sizes of the sets.

    Two sets' different least values have the same register with a probability of about 0.17 / 2**mantissa
    for sets of one size, and less for others.
    """
    chance = 0.1699 * 4.0 * n * m / np.maximum((n + m).astype(float) ** 2, 1) / 2**MANTISSA
    return np.maximum(agree - chance, 0) / (1 - chance)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key1, key2, regs and bands; the last four are null without words."""

    def make(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in SKETCH.split(",")}
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = word_hashes(text or "")
                row: tuple = (doc, 0, None, None, None, None)
                if len(words):
                    own = shingles(words)
                    regs = registers(own)
                    row = (doc, len(own), *sequence_key(words), regs.tobytes(), band_keys(regs))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.map_columns(rows, make, SKETCH)


def _against_leaders(spark: SparkSession, pairs: DataFrame, payload: DataFrame, judge) -> DataFrame:
    """Of pairs (a, b) those that ``judge`` keeps; payload is (id, n_shingles, data).

    ``judge`` gets a leader's (n, data) and arrays of its partners'. A leader's partners are dealt out in
    parts of about ``PART``, and its data goes to each part, so neither data goes with every pair nor does a
    leader with very many partners go to one task.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = shared.save(spark, parts, "parts")
    member = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("b").alias("id"))
    leader = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    rows = member.unionByName(leader).join(payload, "id").select("a", "part", "kind", "id", "n_shingles", "data")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, data = None, 0, b""
        for batch in batches:
            keep: list[int] = []
            heads = np.flatnonzero(batch["kind"].to_numpy() == 0).tolist()
            if first is not None and heads[:1] != [0]:
                heads = [-1, *heads]
            for i, at in enumerate(heads):
                if at >= 0:
                    first, n, data = batch["a"].iloc[at], batch["n_shingles"].iloc[at], batch["data"].iloc[at]
                end = heads[i + 1] if i + 1 < len(heads) else len(batch)
                if end > at + 1:
                    part = slice(at + 1, end)
                    found = judge(n, data, batch["n_shingles"].to_numpy()[part], batch["data"].iloc[part])
                    keep += (np.flatnonzero(found) + at + 1).tolist()
            yield pd.DataFrame({"a": batch["a"].iloc[keep], "b": batch["id"].iloc[keep]})

    return dealt.mapInPandas(run, "a long, b long")


def _sizes_allow(n, m):
    return 100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)


def _probable(n: int, data: bytes, m: np.ndarray, others: pd.Series) -> np.ndarray:
    """Which partners' sizes and registers allow the similarity."""
    own, theirs = np.frombuffer(data, np.uint16), np.frombuffer(b"".join(others), np.uint16).reshape(-1, REGISTERS)
    return _sizes_allow(n, m) & (estimate((theirs == own).mean(1), n, m) >= LEAST_ESTIMATE)


def _similar(n: int, data: bytes, m: np.ndarray, others: pd.Series) -> np.ndarray:
    """Which partners' full sets are similar enough."""
    own = np.frombuffer(data, np.uint64)
    both = np.array([len(np.intersect1d(own, np.frombuffer(x, np.uint64), assume_unique=True)) for x in others], np.int64)
    return 100 * both >= SIMILARITY * (n + m - both)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    values, where, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    kept = times[where] > 1
    owner, column = owner[kept], place[where[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    width, top = 8192, int(column[-1]) + 1 if len(column) else 0
    for low in range(0, top, width):
        a, b = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(left) + len(right), width), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def _candidates(key: int, first: int, second: int, g: pd.DataFrame, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of g) between two blocks of a bucket that sizes and registers allow, across components, tile by tile.

    Only pairs whose first common band is this bucket are looked at, so each pair is confirmed once. ``comp``
    is read anew for each tile.
    """
    regs = np.frombuffer(b"".join(g["regs"]), np.uint16).reshape(-1, REGISTERS)
    n, side = g["n_shingles"].to_numpy(), g["side"].to_numpy()
    tiles = lambda of: np.split(at := np.flatnonzero(side == of), range(TILE, len(at), TILE))
    for u, rows in enumerate(tiles(first)):
        for v, cols in enumerate(tiles(second)):
            if first == second and v < u:
                continue
            x, y = n[rows][:, None], n[cols][None, :]
            near = _sizes_allow(x, y) & (comp[rows][:, None] != comp[cols][None, :])
            if first == second and u == v:
                near = np.triu(near, 1)
            if not near.any():
                continue
            agree = np.zeros(near.shape, np.int16)
            for k in range(REGISTERS):
                agree += regs[rows, k][:, None] == regs[cols, k][None, :]
            i, j = np.nonzero(near & (estimate(agree / REGISTERS, x, y) >= LEAST_ESTIMATE))
            if len(i):
                band = (regs[rows[i]] == regs[cols[j]]).reshape(-1, BANDS, ROWS_OF_BAND).all(2).argmax(1)
                own = np.array([band_keys(regs[r]) for r in rows])[i, band] == key
                yield rows[i[own]], cols[j[own]]


def _links_between(key: int, first: int, second: int, g: pd.DataFrame) -> list[tuple[int, int]]:
    """Links between two blocks of a bucket that join different components; a forest over these."""
    n, comp, ids = (g[c].to_numpy() for c in ("n_shingles", "comp", "id"))
    comp = comp.copy()
    sets = [np.frombuffer(v, np.uint64) for v in g["data"]]
    out = []
    for i, j in _candidates(key, first, second, g, comp):
        u, v = np.unique(i), np.unique(j)
        if len(i) <= 4 * (len(u) + len(v)):
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
        else:
            both = _common([sets[r] for r in u], [sets[c] for c in v])[np.searchsorted(u, i), np.searchsorted(v, j)]
        held = 100 * both >= SIMILARITY * (n[i] + n[j] - both)
        for a, b in zip(i[held].tolist(), j[held].tolist(), strict=True):
            if comp[a] != comp[b]:
                out.append((int(ids[a]), int(ids[b])))
                # Tiles that follow pass over pairs that are connected by now.
                comp[comp == comp[a]] = comp[b]
    return out


def _rest_links(spark: SparkSession, labelled: DataFrame, sizes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) inside buckets (key, id, n_shingles, comp) whose members are in different components.

    A bucket's rows outside its largest component are compared with all of it; the largest component's rows
    are not compared with each other. Both go to the tasks in blocks, or the bucket as a whole if one block holds it.
    """
    by = shared.save(spark, labelled.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes")), "by")
    mixed = by.groupBy("key").agg(F.max(F.struct("n", "comp", "hashes")).alias("top"), F.sum("n").alias("all"), F.sum("hashes").alias("sets"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda c, hashes: F.greatest(F.ceil(c / BLOCK), F.ceil(hashes / MOST_HASHES)).cast("int")
    p, q = blocks(F.col("all") - F.col("top.n"), F.col("sets") - F.col("top.hashes")), blocks(F.col("top.n"), F.col("top.hashes"))
    whole = blocks(F.col("all"), F.col("sets")) == 1
    mixed = shared.save(spark, mixed.select("key", F.col("top.comp").alias("main"), F.when(whole, 1).otherwise(p).alias("p"), F.when(whole, 0).otherwise(q).alias("q")), "mixed")
    rows = labelled.join(mixed, "key")
    main, h = (F.col("comp") == F.col("main")) & (F.col("q") > 0), F.xxhash64("id")
    dealt = rows.withColumn("side", F.when(main, F.col("p") + F.pmod(h, F.col("q"))).otherwise(F.pmod(h, F.col("p"))).cast("int"))
    last = F.when(main, F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other"))
    keys = ["key", "first", "second"]
    dealt = dealt.select(*keys, "side", "id", "comp").join(sizes, "id").repartition(*keys).sortWithinPartitions(*keys)
    schema = "key long, first int, second int, side int, id long, comp long"

    def hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, first, second), g in whole_groups(batches, keys):
            seen = np.zeros(len(g), bool)
            for i, j in _candidates(key, first, second, g, g["comp"].to_numpy()):
                seen[i] = seen[j] = True
            if seen.any():
                yield g.loc[seen, [*keys, "side", "id", "comp"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, first, second), g in whole_groups(batches, keys):
            found = _links_between(key, first, second, g)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    # Registers decide first which documents of two blocks are worth their sets.
    some = shared.save(spark, dealt.mapInPandas(hopeful, schema), "hopeful")
    sets = full_sets(spark, docs, classes.join(some.select("id").distinct(), "id"))
    again = some.join(sets.join(sizes, "id"), "id").repartition(*keys).sortWithinPartitions(*keys)
    out = shared.save(spark, again.mapInPandas(compare, "a long, b long"), "rest")
    for table in (by, mixed, some, sets):
        shared.drop(spark, table)
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of rows that come sorted by ``keys``."""
    left: list[pd.DataFrame] = []
    at: tuple = ()
    for batch in batches:
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = tuple(values[a].tolist())
            if left and at != here:
                yield at, left[0] if len(left) == 1 else pd.concat(left)
                left = []
            at = here
            left.append(batch.iloc[a:b])
    if left:
        yield at, left[0] if len(left) == 1 else pd.concat(left)


def full_sets(spark: SparkSession, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and data, the set of shingles, of ``classes`` (id, doc_id of a member, key1, key2).

    A filter of at most ``MOST_BITS`` bits (16 MB) goes to the tasks, so that texts of other documents are not
    shuffled; what passes it by chance, and other texts under a member's doc_id, go with the join.
    """
    wanted = shared.save(spark, classes.select("id", "doc_id", "key1", "key2"), "wanted")
    bits = 64 * max(1024, min(MOST_BITS, 16 * wanted.count()) // 64)
    at = F.pmod(F.xxhash64("doc_id", F.lit("filter")), F.lit(bits))
    words = wanted.select(F.floor(at / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    held, found = np.zeros(bits // 64, np.int64), words.toArrow()
    held[found["w"].to_numpy()] = found["b"].to_numpy()

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = batch["at"].to_numpy()
            hit = (held[place >> 6] >> (place & 63)) & 1 == 1
            some = [(d, w) for d, t in batch.loc[hit, ["doc_id", "text"]].itertuples(index=False) if len(w := word_hashes(t or ""))]
            keys = [sequence_key(w) for _, w in some]
            yield pd.DataFrame({"doc_id": [d for d, _ in some], "key1": [k[0] for k in keys], "key2": [k[1] for k in keys], "data": [shingles(w).tobytes() for _, w in some]})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("at", at)
    found = rows.mapInPandas(full, "doc_id long, key1 long, key2 long, data binary").join(wanted, ["doc_id", "key1", "key2"])
    out = shared.save(spark, found.select("id", "data").dropDuplicates(["id"]), "sets")
    shared.drop(spark, wanted)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles and stay alone. Equal word sequences are linked. Rows
    that repeat a doc_id are one document: they are in one component, which holds all that is linked with any
    of their texts. A null doc_id stays alone, with a null component, and is kept. Columns other than doc_id
    and text are ignored; an empty table gives no rows.
    """
    shared.text_batches(spark)
    sketch = shared.save(spark, sketches(docs), "sketches")
    named = sketch.where("key1 is not null and doc_id is not null")
    # Equal word sequences are a class with a number of its own: a doc_id may stand with several texts.
    classes = named.groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id())
    classes = shared.save(spark, classes, "classes")
    chosen = named.join(classes, ["doc_id", "key1", "key2"]).dropDuplicates(["id"])
    one = shared.save(spark, chosen.select("id", "n_shingles", "regs", "bands"), "one")

    banded = one.select("id", "n_shingles", F.explode("bands").alias("key"))
    buckets = shared.save(spark, banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1"), "buckets")
    held = shared.save(spark, banded.join(buckets, "key").select("key", "n", "leader", "id", "n_shingles"), "held")
    pairs = held.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    sizes = one.select("id", "n_shingles", "regs")

    probable = shared.save(spark, _against_leaders(spark, pairs, sizes.withColumnRenamed("regs", "data"), _probable), "probable")
    ends = probable.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(spark, docs, classes.join(ends, "id"))
    links = shared.save(spark, _against_leaders(spark, probable, sizes.select("id", "n_shingles").join(sets, "id"), _similar), "links")
    for table in (sets, probable):
        shared.drop(spark, table)
    found = components(spark, links)
    label = F.coalesce("component", "id").alias("comp")
    labelled = held.where("n > 2").join(found, "id", "left").select("key", "id", "n_shingles", label)
    rest = _rest_links(spark, labelled, sizes, docs, classes)
    links = links.unionByName(rest)
    # Classes that share a doc_id are one document's.
    several = named.groupBy("doc_id").agg(F.min("key1").alias("low"), F.max("key1").alias("high"), F.min("key2").alias("low2"), F.max("key2").alias("high2")).where("low <> high or low2 <> high2")
    texts = named.join(several.select("doc_id"), "doc_id").select("doc_id", "key1", "key2").distinct().join(classes.drop("doc_id"), ["key1", "key2"])
    texts = shared.save(spark, texts.select("doc_id", "id"), "texts")
    shared_ids = texts.join(texts.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    if not rest.isEmpty() or not texts.isEmpty():
        found = components(spark, links.unionByName(shared_ids))

    found = shared.save(spark, found, "components")
    least = found.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("least"))
    own = classes.join(found.join(least, "component").select("id", "least"), "id", "left").select("key1", "key2", F.coalesce("least", "doc_id").alias("component_id"))
    own = shared.save(spark, own, "own")
    for table in (one, buckets, held, rest, texts, found):
        shared.drop(spark, table)
    out = sketch.select("doc_id", "n_shingles", "key1", "key2").join(own, ["key1", "key2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
