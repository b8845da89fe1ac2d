"""Best-fit packing by minimum bin slack.

Only lengths matter to a packing, and there are at most ``capacity`` of them.
So the executors tokenize and cut, the driver gets the histogram of piece
lengths (at most ``capacity`` rows), and the minimum-bin-slack heuristic runs
on that histogram: the longest length left opens a bin, a subset-sum dynamic
programme over the bits of one integer finds the fullest combination of the
lengths left, and that pattern is removed as often as the counts allow. Each
piece then finds its bin from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, tokens

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, with the largest sum of at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            k = min(k, left)
            wider = (reach | reach << (length * k)) & mask
            if wider != reach:
                steps.append((length, k, reach))
                reach = wider
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, pieces of each length in one such bin), for every piece of the histogram."""
    left = {k: v for k, v in histogram.items() if v}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan = []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        if not rest[first]:
            del rest[first]
        pattern = fullest(rest, capacity - first)
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        plan.append((times, pattern))
        for k, c in pattern.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
    return plan


def cut_pieces(docs: DataFrame, vocab: str = tokens.DEFAULT_VOCAB, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenized pieces of at most ``capacity`` ids; ``part`` and ``place`` number them by task and length.

    A document's ids are the tokenizer's and then ``end_id``; null text counts as empty. A document that
    is too long gives pieces of exactly ``capacity`` ids, after a first piece with what is over.
    """

    def pieces(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        context = TaskContext.get()
        part, seen = context.partitionId() if context else 0, {}
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(",")}
            found = tokens.encoder(vocab).batch([x or "" for x in batch["text"]])
            for doc, ids in zip(batch["doc_id"], found, strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for i in range(len(edges) - 1):
                    a, b = edges[i], edges[i + 1]
                    place = seen.get(b - a, 0)
                    seen[b - a] = place + 1
                    for column, value in zip(rows.values(), (doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, place), strict=True):
                        column.append(value)
            yield rows

    return shared.map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), pieces, PIECES)


def pack(spark: SparkSession, docs: DataFrame, vocab: str = tokens.DEFAULT_VOCAB, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack documents (``doc_id``, ``text``) into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row per piece. Null and
    empty texts are one piece that holds only ``end_id``; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored. Sequences are gapless from offset 0.
    """
    shared.text_batches(spark)
    pieces = shared.save(spark, cut_pieces(docs, vocab, capacity, end_id), "pieces")
    counts = shared.save(spark, pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, used, sequences = [], dict.fromkeys(histogram, 0), 0
    for times, pattern in plan_bins(histogram, capacity):
        at = 0
        for length, c in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], used[length] + c * times, c, sequences, at))
            used[length] += c * times
            at += c * length
        sequences += times
    # At most two rows for each pattern and length; a pattern uses up a length: bounded by the capacity.
    bins = spark.createDataFrame(rows, "length long, low long, high long, each long, first_id long, first_at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The offsets grow with tasks and lengths, so both sides are dealt by them; a part's pieces of a length are one task's.
    ranked = pieces.join(offsets.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    b = F.broadcast(bins.withColumnRenamed("length", "of"))
    held = ranked.join(b, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    turn = F.col("rank") - F.col("low")
    return held.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_id") + F.floor(turn / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("first_at") + F.pmod(turn, F.col("each")) * F.col("length")).alias("offset"),
    )
