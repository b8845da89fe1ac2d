"""Token totals kept by deltas.

Changes are signed: an insert adds a document and its tokens, a delete takes
them away, a revision moves the tokens by the difference. A batch is summed
by source, language and tokenizer version and committed once: the files go
to a pending folder, which is then renamed to the batch's name; the rename
fails if that is there already. Totals add up the named folders, so a batch
sent again, or a writer that died before the rename, changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

KEYS = ["source", "lang", "tokenizer_version"]
DELTAS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def inserts(rows: DataFrame) -> DataFrame:
    """Signed changes that add ``rows`` (KEYS and tokens; a null count adds a document without tokens)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Signed changes that take ``rows`` away."""
    return inserts(rows).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Signed changes from ``old_tokens`` to ``tokens``."""
    now, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens", "old_tokens"))
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (now - old).alias("tokens"))


class TokenRollup:
    """A table of totals in a folder. Null sources and languages are groups of their own.

    ``epochs/<k>/<batch>`` holds a batch's summed deltas; the highest k counts. A folder gets its place by a
    rename that fails where something is already.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        top = self.hadoop.Path(self.path)
        self.fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.hadoop.FileContext.getFileContext(top.toUri(), spark._jsc.hadoopConfiguration())

    def _list(self, below: str) -> list[str]:
        at = self.hadoop.Path(f"{self.path}/{below}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _epoch(self) -> int:
        return max(map(int, self._list("epochs")), default=0)

    def _place(self, pending: str, below: str) -> bool:
        """Move a folder to where nothing may be yet."""
        to = self.hadoop.Path(f"{self.path}/{below}")
        self.fs.mkdirs(to.getParent())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            self.context.rename(self.hadoop.Path(pending), to, plain)
        except Exception:
            if not self.fs.exists(to):
                raise
            self.fs.delete(self.hadoop.Path(pending), True)
            return False
        return True

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return [x for x in self._list(f"epochs/{self._epoch()}") if x != "compacted"]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False and nothing done if it was committed before."""
        if not batch or "/" in batch or batch == "compacted":
            raise ValueError("a batch needs a name, without / and other than compacted")
        if batch in self.batches():
            return False
        pending = f"{self.path}/pending/{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.where("docs <> 0 or tokens <> 0").write.parquet(pending)
        return self._place(pending, f"epochs/{self._epoch()}/{batch}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs and tokens; groups that came down to nothing are left out."""
        at = f"epochs/{self._epoch()}"
        paths = [f"{self.path}/{at}/{x}" for x in self._list(at)]
        if not paths:
            return self.spark.createDataFrame([], DELTAS)
        rows = self.spark.read.schema(DELTAS).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one; their names stay known, so none is applied again.

        For one maintainer, while no batch is being committed.
        """
        epoch, pending = self._epoch(), f"{self.path}/pending/{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{pending}/compacted")
        for x in self.batches():
            self.fs.mkdirs(self.hadoop.Path(f"{pending}/{x}"))
        self._place(pending, f"epochs/{epoch + 1}")


def count_tokens(spark: SparkSession, docs: DataFrame, vocab: str = tokens.DEFAULT_VOCAB) -> DataFrame:
    """doc_id, source, lang, two hashes of the text, words, bytes and the tokenizer's count, a row per document.

    A null text has null hashes and counts of 0.
    """
    shared.text_batches(spark)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("h1"), F.when(text.isNotNull(), F.xxhash64(F.lit("copy"), text)).alias("h2"),
        F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), text.alias("text"),
    )

    # Arrow, since pandas reads a column with nulls as floats and a hash does not fit into one.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokens.encoder(vocab).batch([x or "" for x in batch.column("text").to_pylist()])
            bpe = pa.array([len(x) // 4 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bpe], names=[*batch.schema.names[:-1], "bpe"])

    return rows.mapInArrow(count, "doc_id long, source string, lang string, h1 long, h2 long, words long, bytes long, bpe long")


def roll_up_documents(spark: SparkSession, docs: DataFrame, path: str, vocab: str = tokens.DEFAULT_VOCAB, restore: bool = False) -> DataFrame:
    """Totals of a corpus after four batches, two of which are sent twice; five with ``restore``.

    ``words``: every document enters with its count of words. ``estimate``: every document enters under the
    tokenizer's version with a quarter of its bytes. ``exact``: these counts are revised to the tokenizer's.
    ``copies``: of documents with the same text all leave and the one with the least doc_id returns.
    ``restored``: that is undone, so that the totals are of all documents and not of distinct texts.
    Null texts count as documents without words or tokens and are no copies of each other. Repeated rows, and
    rows without doc_id, count each; null sources and languages are groups of their own; an empty table gives
    no rows; other columns are ignored.
    """
    counted = shared.save(spark, count_tokens(spark, docs, vocab), "counted")
    name = vocab.rsplit("/", 1)[-1].split(".")[0] + "/1"

    def under(rows: DataFrame, version: str, count, **more) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), count.alias("tokens"), *(c.alias(k) for k, c in more.items()))

    def both(rows: DataFrame) -> DataFrame:
        return under(rows, "words/1", F.col("words")).unionByName(under(rows, name, F.col("bpe")))

    guess = F.floor(F.col("bytes") / 4).cast("long")
    copied = counted.where(F.col("h1").isNotNull())
    keeper = F.min_by(F.struct("source", "lang", "words", "bpe"), F.struct("doc_id", "source", "lang"))
    kept = copied.groupBy("h1", "h2").agg(keeper.alias("k")).select("k.*")
    batches = {
        "words": inserts(under(counted, "words/1", F.col("words"))),
        "estimate": inserts(under(counted, name, guess)),
        "exact": revisions(under(counted, name, F.col("bpe"), old_tokens=guess)),
        "copies": deletes(both(copied)).unionByName(inserts(both(kept))),
        "restored": deletes(both(kept)).unionByName(inserts(both(copied))),
    }
    rollup = TokenRollup(spark, path)
    for batch in ("words", "estimate", "words", "exact", "copies", "copies", *(["restored"] if restore else [])):
        rollup.commit(batch, batches[batch])
    return rollup.totals()
