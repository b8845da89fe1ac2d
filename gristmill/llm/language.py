"""Language identification by compression.

For each language a raw-content zstandard dictionary is made from a bounded
sample of labelled texts. A whole text, in lower case and with a space for
each run of other characters than letters, is encoded once with each
dictionary, in blocks of ``BLOCK_BYTES`` so that the dictionary matters to
all of it; the language whose dictionary gives the fewest bytes is chosen. A
narrow margin is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

UNKNOWN = "und"
#: Bound of the fit: labelled rows of a language, and characters taken from each.
SAMPLE_ROWS = 384
SAMPLE_CHARS = 300
LEVEL = 6
BLOCK_BYTES = 1024
#: Rejected below: bytes saved against the next language, and that as a share of its bytes.
MIN_BYTES = 2
MIN_SHARE = 0.004

LETTER = regex.compile(r"\p{L}")
BETWEEN = re.compile(r"[\W\d_]+")


def remainder(parts: int):
    """crc32 of the document's id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def plain(text: str) -> str:
    """The letters of a text, in lower case."""
    return BETWEEN.sub(" ", text).lower()


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content by language, from rows of ``text`` and ``lang`` where both are known.

    The hash of a text puts it in one of ``rows`` slots of its language; of a slot's texts the one with the
    least hash gives a stretch of ``chars`` characters, at a place that the hash sets. So equal texts count
    once, and at most rows * chars characters a language come to the driver.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    h = F.xxhash64("text")
    at = (F.pmod(h, F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1).cast("int")
    cut = known.select("lang", h.alias("h"), F.substr("text", at, F.lit(chars)).alias("part"))
    kept = cut.groupBy("lang", F.pmod(F.shiftright("h", 20), F.lit(rows)).alias("slot")).agg(F.min(F.struct("h", "part")).alias("least"))
    found: dict[str, list[str]] = {}
    for r in sorted(kept.select("lang", "least.h", "least.part").collect()):
        found.setdefault(r["lang"], []).append(r["part"])
    return {k: " ".join(map(plain, v)).encode() for k, v in sorted(found.items())}


class Classifier:
    """Compressors of all languages, made once in a worker process."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.codecs = []
        for lang in self.langs:
            # Raw content must not look like a trained dictionary, and has 8 bytes at least.
            held = zstandard.ZstdCompressionDict(content[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.codecs.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = plain(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum([len(f(b)) for b in blocks]) for f in self.codecs]

    def predict(self, text: str | None) -> tuple[str, float, bool, int, int]:
        """Language, score, rejected, bytes of the best and of the next one.

        The score is the best language's share when a byte saved counts as a factor of two.
        """
        if text is None or not self.langs or LETTER.search(text) is None:
            return UNKNOWN, 0.0, True, 0, 0
        sizes = self.sizes(text)
        best, *others = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        low = sizes[best]
        after = sizes[others[0]] if others else low
        score = 1.0 / sum(2.0 ** -min(x - low, 60) for x in sizes)
        narrow = bool(others) and (after - low < MIN_BYTES or after - low < MIN_SHARE * after)
        return self.langs[best], score, narrow, low, after


def identify(spark: SparkSession, docs: DataFrame, content: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """lang_pred, score, rejected, bytes_best and bytes_next for each row's whole text, after the columns ``keep``.

    Null texts and texts without a letter are ``und``, score 0, rejected; so is everything when no language
    was learned. Repeated rows give repeated rows. Equal sizes go to the first language by name, and are rejected.
    A column of ``keep`` that bears the name of a result (these have a _ before them) gives way to it.
    """
    shared.text_batches(spark)
    kinds = {"_lang_pred": pa.string(), "_score": pa.float64(), "_rejected": pa.bool_(), "_best": pa.int64(), "_next": pa.int64()}
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in kinds]
    own = "_text"
    while own in keep:
        own += "_"
    source = docs.select(*(F.col(c) for c in keep), F.col("text").cast("string").alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "_lang_pred string, _score double, _rejected boolean, _best long, _next long"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(own).to_pylist()]
            columns = [batch.column(c) for c in keep] + [pa.array([r[i] for r in found], k) for i, k in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *kinds])

    return source.mapInArrow(label, schema)


def predict_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Language of every document; dictionaries come from rows whose remainder modulo 4 is not 2.

    A row for each row, repeated ones too; null texts are ``und``. A null doc_id is learned from by none and
    is not held out. An empty table gives no rows; other columns are ignored.
    """
    fold = remainder(4)
    content = fit(docs.where(fold != 2).select("text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = identify(spark, rows, content)
    return found.select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_rejected").alias("rejected"), F.col("_best").alias("bytes_best"), F.col("_next").alias("bytes_next"),
    )
