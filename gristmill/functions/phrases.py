"""Which of many phrases stand in texts, by an index of the phrases and not by a pattern of all.

A text and a phrase are cut into words and single other characters alike, so
a phrase that stands in a text between word boundaries is a run of the
text's tokens. Runs of the lengths that phrases have meet the phrases by a hash
join, which compares what has one hash. The work is the tokens of the
texts times the number of lengths, however many phrases there are. Spark
broadcasts the phrases if they are few; if not, both sides are shuffled, with
each phrase in ``PARTS`` parts, so a phrase that stands in a third of all
lines is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
#: Starts of runs that are listed at a time, and parts of a phrase's rows in a shuffle.
BLOCK, PARTS = 512, 8


def folded(text: Column) -> Column:
    """Texts that differ in case only become one. A sharp s is not taken for two letters; compare lengths for the ligatures."""
    return F.lower(F.upper(F.replace(text, F.lit("ß"), F.lit("ẞ"))))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def phrase_index(phrases: DataFrame) -> DataFrame:
    """phrase, length, ord, size of phrases (phrase, ord): one for all that differ in case only, the least ``ord``; null and empty ones are left out."""
    one = phrases.where("phrase <> ''").withColumn("_f", folded(F.col("phrase"))).groupBy("_f", F.length("phrase").alias("length")).agg(F.min("ord").alias("ord"))
    return one.select(F.col("_f").alias("phrase"), "length", "ord", F.size(tokens(F.col("_f"))).alias("size"))


def first_phrases(lines: DataFrame, ids: list[str], phrases: DataFrame) -> DataFrame:
    """``ids``, phrase: the phrase (phrase, ord) that stands first in each of ``lines`` (ids, text), as the line writes it.

    Phrases are whole words whatever their case; of several at one place the one with the least ``ord`` counts
    (any type that has an order). Rows with the same ids give one row, lines without a phrase and null texts none.
    A line may be of any length.
    """
    index = phrase_index(phrases)
    sizes = index.agg(F.collect_set("size").alias("s")).scalar()
    rows = lines.where("text <> ''").select(*ids, sizes.alias("_sizes"), F.concat(F.array(F.lit("")), tokens(F.col("text")), F.array(F.lit(""))).alias("_t"))
    rows = rows.where(F.size("_sizes") > 0)
    # A block has the token before its first start, and those that the longest run from its last start and the next one take.
    n = F.size("_t") - 2
    block = lambda b: F.struct(b.alias("b"), F.least(F.lit(BLOCK), n - b).alias("starts"), F.slice("_t", b + 1, F.lit(BLOCK + 1) + F.array_max("_sizes")).alias("t"))
    blocks = rows.select(*ids, "_sizes", F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), block)).alias("_x"))
    starts = blocks.select(*ids, "_sizes", "_x", F.explode(F.sequence(F.lit(1), F.col("_x.starts"))).alias("_i"))
    # A word's inside is no start; neither is what stands behind a word without a gap.
    starts = starts.where(~F.get("_x.t", F.col("_i") - 1).rlike(f"^{WORD}")).select(*ids, "_x", "_i", F.explode("_sizes").alias("size"))
    i, n = F.col("_i"), F.col("size")
    starts = starts.where(i + n < F.size("_x.t")).where(~F.get("_x.t", i + n).rlike(f"^{WORD}"))
    # Said to be never null, so that no filter for nulls computes it a second time.
    said = starts.select(*ids, (F.col("_x.b") + i).alias("_at"), F.coalesce(F.when(n == 1, F.get("_x.t", i)).otherwise(F.array_join(F.slice("_x.t", i + 1, n), "")), F.lit("")).alias("_said"))
    said = said.select(*ids, "_at", "_said", F.coalesce(folded(F.col("_said")), F.lit("")).alias("phrase"), F.pmod(F.xxhash64(*ids), F.lit(PARTS)).alias("_part"))
    parts = index.drop("size").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    whole = said.join(parts, ["phrase", "_part"]).where(F.length("_said") == F.col("length"))
    return whole.groupBy(*ids).agg(F.min_by("_said", F.struct("_at", "ord")).alias("phrase"))


def sizes_of(texts: DataFrame, text: Column) -> Column:
    """The lengths that texts have, as an array for other frames; it grows with the lengths and not with the texts."""
    return texts.agg(F.collect_set(F.length(text)).alias("s")).scalar()
