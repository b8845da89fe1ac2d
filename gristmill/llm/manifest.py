"""Merkle manifests of documents, level by level.

Every document is a leaf. The leaves of a source are numbered in their order,
and level by level the number divided by the fanout names the parent; the
sorted array of its children is hashed into it. A source's last node is its
subroot, and the subroots are the leaves of one more tree, which gives the
root. Then the levels are joined from the top down: the path of a parent to
the root, with the siblings of a child put before it, is the child's path.

A level has a fanout's share of the rows below it, so all levels together
move little more than the lowest. Numbers come from ranges of the order, so a
source may hold any share of the rows. What holds of source and doc_id holds
of any ``group`` and ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value: no two rows share an encoding."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    """Digest of a document's fields; ``values`` take the place of columns."""
    return digest(*(field(values.get(name, F.col(name))) for name in FIELDS))


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` gives with the siblings of ``path``."""
    return F.aggregate(path, node, lambda below, step: digest(step["left"], below, step["right"]))


def proof(path: Column) -> Column:
    """The siblings of all levels, left to right."""
    return joined(F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def levels(spark: SparkSession, nodes: DataFrame, group: str, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels over numbered ``nodes`` (group, node, idx, n and what rows carry), and each group's top.

    A level has a row for each parent: the group, up (its number), n (the group's nodes below), children (its
    nodes in order, on the lowest level with what they carry) and parent (its digest). A top has the group,
    level and node. Both are tables in the shared folder; the number of levels is the logarithm of the largest
    group.
    """
    size = nodes.agg(F.max("n")).first()[0] or 0
    now, child = nodes, F.struct("idx", *(c for c in nodes.columns if c not in ("idx", "n", group)))
    found, tops = [], None
    while True:
        top = now.where("n = 1").select(group, F.lit(len(found)).alias("level"), "node")
        tops = top if tops is None else tops.unionByName(top)
        if size <= 1:
            return found, shared.save(spark, tops, "tops")
        runs = now.where("n > 1").groupBy(group, F.expr(f"idx div {fanout}").alias("up"), "n").agg(F.sort_array(F.collect_list(child)).alias("children"))
        found.append(shared.save(spark, runs.withColumn("parent", F.sha2(joined(F.col("children.node")), 256)), "level"))
        now = found[-1].select(group, F.col("up").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("parent").alias("node"))
        child, size = F.struct("idx", "node"), -(-size // fanout)


def paths(spark: SparkSession, nodes: DataFrame, found: list[DataFrame], tops: DataFrame, group: str) -> DataFrame:
    """All numbered ``nodes`` with ``path``: what stands left and right of each in its run, lowest level first.

    ``tops`` has for each group its level, the ``path`` that goes on from its top, and other columns, which all
    rows of the group get.
    """
    others = [c for c in tops.columns if c not in (group, "level")]
    carried = [c for c in nodes.columns if c not in ("idx", "n", group)]
    above = None
    for height in range(len(found) - 1, -1, -1):
        here = tops.where(F.col("level") == height + 1).select(group, F.lit(0).cast("long").alias("up"), *others)
        above = here if above is None else here.unionByName(above)
        below = found[height].join(above, [group, "up"]).select("*", F.posexplode("children").alias("at", "child"))
        run = F.col("children.node")
        step = F.struct(joined(F.slice(run, F.lit(1), F.col("at"))).alias("left"), joined(F.slice(run, F.col("at") + 2, F.size(run))).alias("right"))
        columns = {c: F.col(c) for c in others} | {"path": F.concat(F.array(step.cast(STEP)), "path")}
        own = [F.col("child.idx").alias("up")] if height else [F.col(f"child.{c}").alias(c) for c in carried]
        above = below.select(group, *own, *(x.alias(c) for c, x in columns.items()))
        above = shared.save(spark, above, "paths") if height else above
    # A group of one node has no level and is its own top.
    alone = nodes.where("n = 1").select(group, *carried).join(tops.where("level = 0").drop("level"), group)
    return alone if above is None else above.unionByName(alone)


def manifest(spark: SparkSession, docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of every row of ``docs``, and ``changed_leaf``.

    The leaf is the digest of doc_id, source, lang, n_chars and text, nulls included; other columns are ignored.
    In a source rows ascend by doc_id, null first, and rows that repeat a doc_id by their leaf; sources ascend
    bytewise, null first and the empty one next. A source of one row has its leaf as subroot, and a single
    subroot is the root; neither adds a step. Repeated rows are leaves each. An empty table gives no rows.
    ``changed_leaf`` is the leaf with ``changed`` in place of the text where that is not null, else null.
    """
    # Sorts like the source with null first, and is never null: "-" stands before "=".
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    other = F.lit(None).cast("string") if changed is None else changed
    leaves = docs.select(group.alias("group"), "doc_id", leaf().alias("node"), F.when(other.isNotNull(), leaf(text=other)).alias("changed_leaf"), F.monotonically_increasing_id().alias("row"))
    leaves = shared.save(spark, leaves, "leaves")
    # The row's number lets repeated rows spread over ranges; their digests are alike.
    nodes = shared.numbered(spark, leaves, "group", ["doc_id", "node", "row"])
    shared.drop(spark, leaves)
    found, tops = levels(spark, nodes, "group", fanout)
    upper = shared.numbered(spark, tops.select(F.lit("").alias("all"), "group", "level", "node"), "all", ["group"])
    higher, last = levels(spark, upper, "all", fanout)
    root = (last.first() or {"node": None})["node"]
    ends = last.select("all", "level", F.array().cast(f"array<{STEP}>").alias("path"))
    subroots = shared.save(spark, paths(spark, upper, higher, ends, "all").select("group", "level", F.col("node").alias("subroot"), "path"), "subroots")
    rows = paths(spark, nodes, found, subroots, "group")
    source = F.when(F.col("group") != "-", F.substring("group", 2, 2**31 - 1))
    return rows.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), "changed_leaf", "subroot", F.lit(root).cast("string").alias("root"), "path")


def verify(spark: SparkSession, docs: DataFrame, changed: Column, fanout: int = FANOUT) -> DataFrame:
    """Digests of every document, and whether its leaf still leads to the root once ``changed`` is its text.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of all siblings on the path), folded_root and verified.
    """
    rows = manifest(spark, docs, changed, fanout)
    folded = fold(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    found = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends(of: int = 2) -> Column:
    """The text without its line feeds for one document in ``of``, drawn by its id's crc32; else null."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == 0
    return F.when(drawn, F.replace("text", F.lit("\n"), F.lit("")))
