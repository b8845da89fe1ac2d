"""Spelling variants of words, without pairs.

Two words are near if they differ by one inserted, deleted or replaced code
point. Every word stands in one wildcard group for each of its positions: the
position, what stands before it and what stands after it. Words of a group
differ by a replacement there, and two words meet in one group at most. A
group keeps its size and its first two words; so each member learns how many
near words it has there and which of them is the first that is not itself.
A word without one of its letters is looked up among the words, which tells
both of an insertion; those that drop to the same word keep their number and
their first one.

What stands around a place is held as polynomial hashes under four primes,
124 bits in all, so a word costs work and bytes in proportion to its length.
Words go by their rank, most frequent first and then in code-point order: the
first near word is the one with the least rank. A group has at most one word
for each letter, or for each letter and position, so none grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a code point.
DROPPED = 31
#: The greatest primes below 2^31, and a base for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
BASES = np.array([911382323, 972663749, 1046527733, 787846414], np.int64)
INVERSES = np.array([pow(int(b), -1, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.int64)
#: Keys that are made at once, unless one word has more.
BATCH_KEYS = 100_000
#: Kinds of keys.
WORD, SHORTER, OPEN = 0, 1, 2
KEYS = "rank long, kind int, a long, b long"
#: A form is ten times as frequent, so a chain of them has fewer than 19 steps; each round doubles the steps.
MOST_ROUNDS = 6


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int = DROPPED) -> DataFrame:
    """word and n of all runs of letters in whole texts, after one in ``dropped`` of them has lost a code point.

    Runs are maximal; A to Z are lower-cased. The run's hash is the crc32 of doc_id (nothing if null), a colon
    and the run. Null texts have no runs, repeated rows count each. Only words of at least ``least_length`` code
    points that occur ``least_count`` times are returned.
    """
    # A maximal run of the least length; shorter ones leave no word.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = found.select(F.when(F.col("h") % dropped == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _powers(count: int) -> np.ndarray:
    """The bases' powers modulo the primes: a row for each exponent from 0 to ``count`` - 1."""
    out = np.ones((1, 4), np.int64)
    while len(out) < count:
        out = np.concatenate([out, out * (out[-1] * BASES % PRIMES) % PRIMES])
    return out[:count]


def word_keys(words: list[str]) -> dict[str, np.ndarray]:
    """Hashes ``a`` and ``b`` of the words' (``of``, by place) strings of three kinds.

    WORD: the word. SHORTER: it without a code point, once for each different rest. OPEN: it with nothing at one
    place, the others where they were, once for each position. An open place says where it is and how long the
    word is, so OPEN keys are equal for words that differ only there; they are not to be compared with others.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64) + 1
    of = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    here = np.arange(len(codes))
    at = here - first[of]
    terms = codes[:, None] * _powers(int(sizes.max(initial=0)))[at] % PRIMES
    # Residues under 2^31, so that 2^32 of them could be summed up.
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(terms, axis=0)])
    whole = (sums[first + sizes] - sums[first]) % PRIMES
    before = (sums[here] - sums[first[of]]) % PRIMES
    behind = (sums[(first + sizes)[of]] - sums[here + 1]) % PRIMES
    # Among equal neighbours it is the same whichever goes.
    anew = np.ones(len(codes), bool)
    anew[1:] = (codes[1:] != codes[:-1]) | (at[1:] == 0)
    shorter = ((before + behind * INVERSES % PRIMES) % PRIMES)[anew]
    all_ = np.concatenate([whole, shorter, (before + behind) % PRIMES])
    kind = np.repeat(np.array([WORD, SHORTER, OPEN], np.int32), [len(words), len(shorter), len(codes)])
    return {"of": np.concatenate([np.arange(len(words)), of[anew], of]), "kind": kind, "a": all_[:, 0] << 32 | all_[:, 1], "b": all_[:, 2] << 32 | all_[:, 3]}


def keys(spark: SparkSession, vocabulary: DataFrame) -> DataFrame:
    """The keys of all words of ``vocabulary`` (rank, word)."""
    shared.text_batches(spark, 10_000)
    schema = pa.schema([("rank", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, words, start = batch.column(0).to_numpy(), batch.column(1).to_pylist(), 0
            while start < len(words):
                end, made = start + 1, 2 * len(words[start])
                while end < len(words) and made + 2 * len(words[end]) <= BATCH_KEYS:
                    made += 2 * len(words[end])
                    end += 1
                found = word_keys(words[start:end])
                columns = [ranks[start:end][found["of"]], found["kind"], found["a"], found["b"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)
                start = end

    return vocabulary.select("rank", "word").mapInArrow(work, KEYS)


def near_words(spark: SparkSession, vocabulary: DataFrame) -> DataFrame:
    """rank, n_near and best (the least rank of a near word) of each word that has near words.

    ``vocabulary`` has different words, each with its own rank.
    """
    found = keys(spark, vocabulary).withColumn("open", F.col("kind") == OPEN)
    group = Window.partitionBy("open", "a", "b")
    ranked = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = F.when(F.col("kind") == SHORTER, F.col("rank"))
    found = found.select(
        "rank", "kind", "open",
        F.count("*").over(ranked).alias("size"), F.first("rank").over(ranked).alias("one"), F.nth_value("rank", 2).over(ranked).alias("two"),
        # Where words get shorter: the word that they drop to, if it is one, and the longer ones.
        F.max(F.when(F.col("kind") == WORD, F.col("rank"))).over(ranked).alias("word"), F.count(longer).over(ranked).alias("longer"), F.min(longer).over(ranked).alias("least"),
    ).where("size > 1 and (open or word is not null)")
    others = F.when(F.col("open"), F.col("size") - 1).when(F.col("kind") == WORD, F.col("longer")).otherwise(F.lit(1))
    best = F.when(F.col("open"), F.when(F.col("one") == F.col("rank"), F.col("two")).otherwise(F.col("one"))).when(F.col("kind") == WORD, F.col("least")).otherwise(F.col("word"))
    return found.select("rank", others.alias("others"), best.alias("best")).groupBy("rank").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def last_forms(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """rank and root (the last form's rank) for ``forms`` (rank, form): every round follows twice as many steps."""
    now = shared.save(spark, forms.select("rank", F.col("form").alias("root")), "roots")
    for _ in range(MOST_ROUNDS):
        onward = now.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        moved = now.join(onward, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = shared.save(spark, moved, "roots")
        now, more = moved.drop("moved"), not moved.where("moved").isEmpty()
        if not more:
            return now
    raise RuntimeError("forms go round in a circle")


def variants(spark: SparkSession, docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, dropped: int = DROPPED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text), as ``count_words`` counts it.

    n_near counts the near words; form is the most frequent of them (of equal ones the first in code-point
    order) if it occurs ``ratio`` times as often as the word, with form_n, else null; root follows forms to the
    last and is the word itself if it has none. An empty table, or one without texts, gives no rows; other
    columns are ignored.
    """
    counted = count_words(docs, least_length, least_count, dropped)
    ranked = shared.numbered(spark, counted.select(F.lit("").alias("all"), "word", (-F.col("n")).alias("less")), "all", ["less", "word"])
    words = ranked.select(F.col("idx").alias("rank"), "word", (-F.col("less")).alias("n"))
    near = shared.save(spark, near_words(spark, words), "near")
    target = words.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    named = near.join(target, "best").join(words.select("rank", "n"), "rank")
    forms = shared.save(spark, named.where(F.col("best_n") >= ratio * F.col("n")).select("rank", F.col("best").alias("form"), F.col("best_n").alias("form_n")), "forms")
    roots = last_forms(spark, forms)
    name = lambda of: words.select(F.col("rank").alias(f"{of}_rank"), F.col("word").alias(of))
    linked = forms.withColumnRenamed("form", "form_rank").join(roots.withColumnRenamed("root", "root_rank"), "rank")
    linked = linked.join(name("form"), "form_rank").join(name("root"), "root_rank").select("rank", "form", "form_n", "root")
    found = words.join(near.select("rank", "n_near"), "rank", "left").join(linked, "rank", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
