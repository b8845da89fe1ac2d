"""Near-duplicate vectors by lattice hashing.

In each of several tables a random projection takes a unit vector to eight
dimensions, where it is decoded to the nearest point of the E8 lattice: its
home cell. It is also shown to the neighbouring cells that are nearest to it.
Vectors that meet in a cell, one of them at home, are compared by cosine.

A pair can meet in many cells; only the first of these, in a fixed order that
both vectors' cells decide, counts it. So links are counted inside the tasks
and no pair leaves them: a task returns counts, and a spanning forest of its
links for the components. Large cells are dealt out in pairs of blocks.
Vectors that are equal are one class, with its size as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components
from .neardup import mix

COSINE = 0.95
PROBES = 2
#: Length of a unit vector's projection, in units of a lattice whose points are at least sqrt(2) apart, for so
#: many vectors or fewer; it grows with the sixteenth root of their number, so that the rows of a cell grow with
#: the square root.
SCALE, SCALE_ROWS = 0.85, 100_000
#: Tables are as many as find a pair at the least cosine with this probability.
LEAST_FOUND = 0.999
BLOCK = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([0.5 if signs >> i & 1 else -0.5 for i in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


NEIGHBOURS = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of D8, or of D8 moved by a half."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def _cell(points: np.ndarray, table: int, width: int) -> np.ndarray:
    """64-bit names of lattice points."""
    name = np.full(len(points), (table + 1) * 1_000_003 + width, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).T:
        name = mix(name ^ (column.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return name.view(np.int64)


def layout(rows: int, least: float = COSINE) -> tuple[int, float]:
    """(tables, scale) for a number of vectors: how many tables a scale needs is measured on random pairs at the least cosine."""
    scale = SCALE * max(1.0, rows / SCALE_ROWS) ** (1 / 16)
    random = np.random.default_rng(11)
    a, b = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in random.standard_normal((2, 2000, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b *= np.sqrt(1 - least * least) / np.sqrt((b * b).sum(1, keepdims=True))
    x, y = (cells(v, 4, PROBES, scale) for v in (a, least * a + b))
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean()
    return max(1, int(np.ceil(np.log(1 - LEAST_FOUND) / np.log(1 - np.clip(met, 0.02, 0.999))))), scale


def cells(units: np.ndarray, tables: int, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cells of unit vectors: shape (vectors, tables, 1 + probes), the home first."""
    n, width = units.shape
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        random = np.random.default_rng([width, t])
        projection, shift = random.standard_normal((width, 8)), random.random(8)
        x = units @ projection * scale + shift
        home = nearest_e8(x)
        gain = (x - home) @ NEIGHBOURS.T
        near = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = _cell(home, t, width)
        for p in range(probes):
            out[:, t, 1 + p] = _cell(home + NEIGHBOURS[near[:, p]], t, width)
    return out


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cell that counts the pair (x[i], y[i]), from their cells; symmetric in x and y."""
    out = np.zeros(len(x), np.int64)
    open_ = np.ones(len(x), bool)
    for t in range(x.shape[1]):
        same = open_ & (x[:, t, 0] == y[:, t, 0])
        out[same] = x[same, t, 0]
        open_ &= ~same
        low = np.full(len(x), np.iinfo(np.int64).max)
        for p in range(1, x.shape[2]):
            for home, probe in ((x, y), (y, x)):
                met = home[:, t, 0] == probe[:, t, p]
                low[met] = np.minimum(low[met], home[met, t, 0])
        met = open_ & (low != np.iinfo(np.int64).max)
        out[met] = low[met]
        open_ &= ~met
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) over n nodes make a spanning forest."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep[k] = True
    return keep


def _decoded(column: pd.Series, kind: type) -> np.ndarray:
    """Binary values as rows of one array; as an array of arrays where their lengths differ."""
    if column.map(len).nunique() <= 1:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
    out = np.empty(len(column), object)
    out[:] = [np.frombuffer(x, kind) for x in column]
    return out


def _group_arrays(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Whole groups of rows that come sorted by ``keys``, as arrays: cells are small and many, so frames would cost more than they hold."""
    at, left = None, []
    for batch in batches:
        if not len(batch):
            continue
        arrays = {c: batch[c].to_numpy() for c in batch.columns if c not in ("unit", "cells")}
        arrays |= {"unit": _decoded(batch["unit"], np.float64), "cells": _decoded(batch["cells"], np.int64)}
        values = np.stack([arrays[k] for k in keys], 1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b, here in zip(cuts, cuts[1:], values[cuts[:-1]].tolist(), strict=False):
            part = {c: v[a:b] for c, v in arrays.items()}
            if left and at != here:
                yield tuple(at), _together(left)
                left = []
            at = here
            left.append(part)
    if left:
        yield tuple(at), _together(left)


def _together(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """One group from its parts; its vectors have one length, as this is in their cells' names."""
    rows = [{c: np.stack(v) if v.dtype == object else v for c, v in p.items()} for p in parts]
    return rows[0] if len(rows) == 1 else {c: np.concatenate([p[c] for p in rows]) for c in rows[0]}


def _links_of_group(key: int, first: int, second: int, g: dict[str, np.ndarray], least: float) -> tuple | None:
    side, home, units = g["side"], g["home"], g["unit"]
    if first == second:
        rows = cols = slice(None)
        near = np.triu(units @ units.T >= least, 1)
    else:
        rows, cols = np.flatnonzero(side == first), np.flatnonzero(side == second)
        near = units[rows] @ units[cols].T >= least
    if not near.any():
        return None
    near &= home[rows][:, None] | home[cols][None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return None
    ids, weight, of = g["id"], g["weight"], g["cells"].reshape(len(side), -1, 1 + PROBES)
    if first != second:
        i, j = rows[i], cols[j]
    counts = np.zeros(len(side), np.int64)
    for at in range(0, len(i), 65536):
        a, b = i[at : at + 65536], j[at : at + 65536]
        own = _first_meeting(of[a], of[b]) == key
        np.add.at(counts, a[own], weight[b[own]])
        np.add.at(counts, b[own], weight[a[own]])
    keep = _forest(len(side), i, j)
    return ids[counts > 0], counts[counts > 0], ids[i[keep]], ids[j[keep]]


def hashed(classes: DataFrame, tables: int, scale: float) -> DataFrame:
    """id, weight, unit (doubles) and cells (longs) of classes (id, weight, embedding) of usable vectors."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["embedding"].map(len)
            for _, part in batch.groupby(sizes):
                x = np.array(part["embedding"].tolist(), np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                found = cells(x, tables, PROBES, scale)
                yield pd.DataFrame({"id": part["id"], "weight": part["weight"], "unit": [r.tobytes() for r in x], "cells": [r.tobytes() for r in found], "keys": list(found.reshape(len(part), -1))})

    return classes.mapInPandas(make, "id long, weight long, unit binary, cells binary, keys array<long>")


def near_vectors(spark: SparkSession, embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of ``embeddings`` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths are never linked. Equal vectors are linked, also where they repeat a vec_id; rows that
    repeat it with another vector are counted and linked by their own. A row without vec_id links with nothing,
    has a null component and is kept. An empty table gives no rows. Other columns are ignored.
    """
    shared.text_batches(spark, 4000)
    values = F.col("embedding").cast("array<double>")
    usable = F.size("v") > 0
    usable &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v"))
    good = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & usable)
    # Adding 0 makes both zeros one.
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), F.col("v")))
    # Equal vectors are a class with a number of its own: a vec_id may stand with several vectors.
    counted = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id())
    counted = shared.save(spark, counted, "vectors")
    named = shared.save(spark, good.select("vec_id", "h1", "h2"), "names")
    classes = good.join(counted, ["vec_id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "weight", F.col("v").alias("embedding"))
    data = shared.save(spark, hashed(classes, *layout(counted.count(), least)), "hashed")

    shown = data.select("id", F.posexplode("keys").alias("at", "key")).select("id", "key", (F.col("at") % (1 + PROBES) == 0).alias("home"))
    # A cell that is nobody's home, or that one vector alone sees, makes no pair.
    sizes = shown.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived")
    sizes = shared.save(spark, sizes.select("key", "n"), "sizes")
    met = shown.join(sizes, "key").join(data.select("id", "weight", "unit", "cells"), "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other"))
    keys = ["key", "first", "second"]
    dealt = met.select(*keys, "side", "home", "id", "weight", "unit", "cells").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def rows() -> pd.DataFrame:
            ids, counts, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pd.DataFrame({"a": np.concatenate([ids, a]), "b": np.concatenate([np.full(len(ids), -1), b]), "n": np.concatenate([counts, np.zeros(len(a), np.int64)]), "edge": np.repeat([False, True], [len(ids), len(a)])})

        for (key, first, second), g in _group_arrays(batches, keys):
            found = _links_of_group(key, first, second, g, least)
            if found:
                held.append(found)
                if len(held) >= 1000 or sum(len(x[0]) for x in held[-1:]) > 10_000:
                    yield rows()
        if held:
            yield rows()

    found = shared.save(spark, dealt.mapInPandas(compare, "a long, b long, n long, edge boolean"), "met")
    shared.drop(spark, data)
    links = found.where("not edge").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = shared.save(spark, components(spark, found.where("edge").select("a", "b")), "components")
    least_of = comps.join(counted.select("id", "vec_id"), "id").groupBy("component").agg(F.min("vec_id").alias("least"))
    known = counted.join(links, "id", "left").join(comps.join(least_of, "component"), "id", "left")
    known = shared.save(spark, known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")), "known")
    linked = named.join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    bad = F.col("v").isNull() | F.col("vec_id").isNull() | ~F.coalesce(usable, F.lit(False))
    alone = rows.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
