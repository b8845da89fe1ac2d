"""Byte-level BPE ids with a bounded cache of the pieces between spaces.

The vocabulary's splitting pattern always starts a new piece at a space that
is followed by a character other than white space. So a text may be cut
there, and the ids of the parts, one after another, are the ids of the text.
Texts that could hold a special token's string are encoded whole.

The tokenizers file says what the ids are. Pieces that the cache lacks go,
joined, through a tiktoken encoding made from that same file, which is
several times as fast; a file for which the two differ on ``PROBE``, or which
is no such vocabulary, is left to tokenizers alone.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

DEFAULT_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
#: Cached pieces a worker process keeps (about 0.25 KB each).
CACHE_ENTRIES = 400_000
#: Longer pieces are encoded but not kept.
CACHED_CHARS = 48
#: A space that may stand inside a run of white space, or at the end.
UNSURE = re.compile("[ ](?=[\\s\\u180e]|$)|\0|<\\|")
#: The same for Arrow, which has no look-ahead; all that is a space to Python.
UNSURE_ARROW = r"[ ](?:[\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]|\z)|\x00|<\|"
#: Different pieces of a column that are encoded as one text.
JOINED = 65536
CUT = re.compile("(?=[ ][^\\s\\u180e])")
PROBE = "It's 1234 naïve übel… don't\n\n  x\t\ty  日本 a_b--c %%% ÉÈ don'T we'LL\u00a0z \U0001f600"

_encoders: dict[str, Encoder] = {}


def fast_encoding(vocab: str) -> tiktoken.Encoding | None:
    """The same vocabulary for tiktoken, or None."""
    tokens = json.load(open(vocab, encoding="utf-8"))
    special = {t["content"] for t in tokens.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    try:
        ranks = {bytes(byte_of[c] for c in t): i for t, i in tokens["model"]["vocab"].items() if t not in special}
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (KeyError, TypeError, ValueError):
        return None


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocab: str):
        self.tokenizer = Tokenizer.from_file(vocab)
        self.cache: dict[str, bytes] = {}
        self.fast = fast_encoding(vocab)
        if self.fast and self.fast.encode_ordinary(PROBE) != self.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            self.fast = None
        if self.fast:
            sizes = {i: len(t) for t, i in self.fast._mergeable_ranks.items()}
            self.sizes = np.zeros(max(sizes) + 1, np.int64)
            self.sizes[list(sizes)] = list(sizes.values())

    def _slow(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a space, encoded as one text and parted by their bytes."""
        if not self.fast:
            return self._slow(pieces)
        ids = np.array(self.fast.encode_ordinary("".join(pieces)), "<u4")
        ends = np.cumsum([len(p.encode()) for p in pieces])
        edges = [0, *(4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right")).tolist()]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def cut(self, text: str) -> list[str]:
        if UNSURE.search(text) is None:
            return text.replace(" ", "\0 ").split("\0")
        return [text] if "<|" in text else CUT.split(text)

    def batch(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        known = self.cache
        missing = {p for parts in cut for p in parts if p not in known}
        extra: dict[str, bytes] = {}
        whole = [p for p in missing if not p.startswith(" ") or "<|" in p or p.isspace()]
        joined = list(missing.difference(whole))
        for encode, some in ((self._slow, whole), (self._encode, joined)):
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                for piece, ids in zip(part, encode(part), strict=True):
                    (known if len(piece) <= CACHED_CHARS and len(known) < CACHE_ENTRIES else extra)[piece] = ids
        if not extra:
            return [b"".join([known[p] for p in parts]) for parts in cut]
        return [b"".join([known[p] if p in known else extra[p] for p in parts]) for parts in cut]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin, with the end as last; a null text has none.

        Each different piece of the column is encoded once, and no piece becomes a Python string of its own.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sure = ~pc.match_substring_regex(texts, UNSURE_ARROW).to_numpy(zero_copy_only=False)
        if not self.fast or not sure.all():
            bare = np.flatnonzero(sure) if self.fast else np.zeros(0, np.int64)
            flat, ends = self._column(texts.take(pa.array(bare))) if len(bare) else (None, None)
            rest = np.setdiff1d(np.arange(len(texts)), bare)
            found = dict(zip(bare.tolist(), np.split(flat, ends[1:-1]) if len(bare) else [], strict=True))
            found |= {i: np.frombuffer(x, "<u4") for i, x in zip(rest.tolist(), self.batch(texts.take(pa.array(rest)).to_pylist()), strict=True)}
            rows = [found[i] for i in range(len(texts))]
            return np.concatenate([np.zeros(0, "<u4"), *rows]), np.cumsum([0, *map(len, rows)])
        return self._column(texts)

    def _column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts in which every space starts a piece."""
        parts = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        pieces = parts.flatten().dictionary_encode()
        kinds = pieces.dictionary
        spaced = pc.starts_with(kinds, " ").to_numpy(zero_copy_only=False)
        count, found = np.zeros(len(kinds), np.int64), []
        order = [*np.flatnonzero(~spaced), *np.flatnonzero(spaced)]
        bare = kinds.filter(pa.array(~spaced)).to_pylist()
        for at in range(0, len(bare), 4096):
            found += [np.frombuffer(x, "<u4") for x in self._slow(bare[at : at + 4096])]
        count[~spaced] = [len(x) for x in found]
        which, joined = np.flatnonzero(spaced), kinds.filter(pa.array(spaced))
        for at in range(0, len(which), JOINED):
            part = joined.slice(at, JOINED)
            ids = np.array(self.fast.encode_ordinary(pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), "")[0].as_py()), "<u4")
            ends = np.cumsum(pc.binary_length(part).to_numpy())
            count[which[at : at + JOINED]] = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right"), prepend=0)
            found.append(ids)
        flat = np.concatenate([np.zeros(0, "<u4"), *found])
        start = np.zeros(len(kinds), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        index = pieces.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(count[index])])
        size = np.diff(ends)
        ids = flat[np.repeat(start[index] - ends[:-1], size) + np.arange(ends[-1])]
        # Offsets of the list count from its first row.
        return ids, ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def encoder(vocab: str = DEFAULT_VOCAB) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if vocab not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocab] = Encoder(vocab)
    return _encoders[vocab]
