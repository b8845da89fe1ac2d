"""SentencePiece ids of merge-type vocabularies, and their text again.

A text is escaped (a space is ``▁``, one more stands before all) and its
characters are symbols. An agenda holds every pair of adjacent symbols whose
join is in the vocabulary, ordered by score and then from the left; the best
pair becomes one symbol, and its new pairs with both neighbours join the
agenda. What is no piece in the end is written in bytes.

No piece of such a vocabulary goes on over a space after a word, or over a
line feed, so a text falls there into segments that never meet in a merge; a
model file that has such a piece is an error. A worker keeps the ids of segments that it has seen. All segments
that are new in an Arrow batch go through the agenda, and then, joined,
through the sentencepiece library; a difference is an error.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DEFAULT_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Cached segments of a worker process (about 0.2 KB each); longer ones are encoded but not kept.
CACHE_ENTRIES, CACHED_CHARS = 500_000, 48
#: Longer segments keep their agenda in a heap.
SHORT = 32
NEVER = float("inf")
ENCODED = "_doc_id long, _ids binary, _text string"

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, by one model file."""

    def __init__(self, model: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        kinds = [(sp.is_unknown(i) or sp.is_control(i), sp.is_byte(i), sp.is_unused(i)) for i in range(sp.get_piece_size())]
        if any(unused for _, _, unused in kinds):
            raise ValueError(f"{model}: unused pieces are not known here")
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i, (special, byte, _) in enumerate(kinds):
            piece = sp.id_to_piece(i)
            if byte:
                self.bytes[int(piece[1:-1], 16)] = i
            elif not special:
                self.ids[piece] = i
        self.order = {piece: -sp.get_score(i) for piece, i in self.ids.items()}
        self.unknown, self.start, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.ids):
            raise ValueError(f"{model}: pieces that go on over a space or a line feed are not known here")
        self.cache: dict[str, bytes] = {}
        self.cuts = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=\n)|(?=\n)")

    def segments(self, text: str) -> list[str]:
        """Parts of the escaped text that share no piece; an empty text has none."""
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in escaped or "\0" in text:
            return [s for s in self.cuts.split(escaped) if s]
        parts = escaped.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0")
        return [s for s in parts if s]

    def merge(self, segment: str) -> list[str]:
        """The symbols that are left when no adjacent pair is a piece."""
        if len(segment) > SHORT:
            return self._merge_long(segment)
        symbols, order = list(segment), self.order.get
        # The agenda as a list that stands beside the symbols: its least entry comes next, the leftmost of equal ones.
        agenda = [order(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = order(both + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = order(symbols[i - 1] + both, NEVER)
        return symbols

    def _merge_long(self, segment: str) -> list[str]:
        """The same with a heap, whose work grows with the length and its logarithm."""
        symbols: list[str] = list(segment)
        before, after = [*range(-1, len(symbols) - 1)], [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (both := symbols[left] + symbols[right]) in self.order:
                heapq.heappush(agenda, (self.order[both], left, right, both))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            # A proposal is stale when one of its symbols has grown or gone since.
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [s for s in symbols if s]

    def encode(self, segment: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(segment):
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def check(self, new: dict[str, list[int]]) -> None:
        """The library's ids of ``new`` segments, joined by line feeds to one text, must be the agenda's."""
        feed = self.encode("\n")
        got = self.library.encode("\n" + "\n".join(new))
        want = self.encode(SPACE)  # stands before every text
        for ids in new.values():
            want += feed
            want += ids
        if got != want:
            raise ValueError(f"the library does not encode {list(new)[:20]} and so on as the agenda does")

    def batch(self, texts: list[str]) -> list[bytes]:
        parts = [self.segments(t) for t in texts]
        known = self.cache
        missing = dict.fromkeys(s for p in parts for s in p if s not in known)
        found = {s: self.encode(s) for s in missing}
        if found:
            self.check(found)
        extra: dict[str, bytes] = {}
        for s, ids in found.items():
            (known if len(s) <= CACHED_CHARS and len(known) < CACHE_ENTRIES else extra)[s] = np.array(ids, "<u4").tobytes()
        head, tail = (np.array([x], "<u4").tobytes() for x in (self.start, self.end))
        return [head + b"".join([known[s] if s in known else extra[s] for s in p]) + tail for p in parts]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)


def encoder(model: str = DEFAULT_MODEL) -> Encoder:
    """This process's encoder of a model file."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def round_trip(spark: SparkSession, docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end ids) and decoded text of every document.

    A null text counts as empty and has the begin and end ids alone. Rows that repeat, and rows without doc_id,
    are encoded each; an empty table gives no rows; other columns are ignored. Texts of any length are encoded
    whole.
    """
    shared.text_batches(spark)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        found = encoder(model)
        for batch in batches:
            ids = found.batch([t or "" for t in batch["text"]])
            yield {"_doc_id": batch["doc_id"], "_ids": ids, "_text": found.decode(ids)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.map_columns(rows, work, ENCODED).toDF("doc_id", "ids", "decoded")


def digests(spark: SparkSession, docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    found = round_trip(spark, docs, model)
    count = F.expr("octet_length(ids) div 4").cast("long")
    return found.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
