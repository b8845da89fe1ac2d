"""Masked pseudo-likelihood scores from a bidirectional window network.

Tokens are byte-level BPE ids, ranked by their counts in all documents. The
network embeds the two tokens on each side, mixes them by a matrix for each
side into one hidden layer, and predicts the token in two steps: a softmax
over classes of tokens that are neighbours in rank, and a softmax over the
tokens of the class. Each token has its own input and output weights, and
probabilities add up to one over the whole vocabulary. A document's score is
the sum over its tokens of log P(token | both sides).

Training masks every position of every document once. Documents are dealt by
their hash to shards of about ``SHARD_BYTES`` of text; each round takes its
share of a shard's stretches of ``STEP_TOKENS`` positions, every shard
improves its own copy of the network on them by Adagrad, in numpy, and the
copies are averaged by the tokens that they saw. So the network follows from
the documents and not from how the table was split, and what is gathered,
counts and weights, follows the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

SIDES = (-2, -1, 1, 2)
REACH = 2
#: A class of tokens that have a share p of the corpus each has SPREAD / sqrt(p) of them, MOST at most: then its
#: output in the first step and its part of the second cost a token about the same.
SPREAD, MOST = 2.5, 1 << 14
WIDTH = 16
ROUNDS, STEP_TOKENS, RATE = 2, 16384, 0.2
SHARD_BYTES = 16 << 20
#: Rows of a table of weights that are added up together.
ROW_BLOCK = 512
#: Exponents that neither overflow nor vanish in a sum of floats.
SAFE = 60
#: Added to every token's count.
SMOOTHING = 0.5
#: Tasks that add up copies before the last sum.
ADDERS = 64


class Vocabulary:
    """Ranks of all ids by count, and the classes that the ranks fall into."""

    def __init__(self, counts: dict[int, int], size: int):
        n = np.full(size, SMOOTHING)
        for i, c in counts.items():
            n[i] += c
        order = np.lexsort((np.arange(size), -n))
        self.size = size
        self.rank = np.empty(size, np.uint16 if size < 65536 else np.uint32)
        self.rank[order] = np.arange(size)
        n = n[order] / n.sum()
        edges = [0]
        while edges[-1] < size:
            edges.append(min(size, edges[-1] + int(min(MOST, max(1, SPREAD / np.sqrt(n[edges[-1]]))))))
        #: Class k holds the ranks from edges[k] to edges[k + 1].
        self.edges = np.array(edges)
        self.classes = len(edges) - 1
        #: The class of a rank; ``classes`` for what stands beyond the ends.
        self.of = np.repeat(np.arange(self.classes + 1), [*np.diff(edges), 1]).astype(np.uint8 if self.classes < 255 else np.uint16)
        total = np.add.reduceat(n, edges[:-1])
        self.class_bias = np.log(total).astype(np.float32)
        self.inner_bias = np.log(n / total[self.of[:-1]]).astype(np.float32)


class Network:
    """Weights, with Adagrad's sums of squares beside them.

    ``dense``: mixing matrices, hidden bias and class outputs, in one array. ``inputs``: a row a rank and one
    for what stands beyond the ends. ``inner``: a column a rank. Outputs have the bias as their last row.
    ``squares`` and ``met`` have an entry for each rank: the sum of squares, and the slopes that moved it.
    """

    def __init__(self, vocabulary: Vocabulary):
        random = np.random.default_rng(7)
        shapes = [(len(SIDES), WIDTH, WIDTH), (WIDTH,), (WIDTH + 1, vocabulary.classes)]
        self.edges = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        self.shapes = shapes
        self.dense = np.zeros(self.edges[-1], np.float32)
        self.dense_squares = np.full(self.edges[-1], 1e-3, np.float32)
        mixing, _, outputs = self.parts()
        mixing[:] = random.standard_normal(mixing.shape) / np.sqrt(WIDTH)
        outputs[WIDTH] = vocabulary.class_bias
        self.inputs = (random.standard_normal((vocabulary.size + 1, WIDTH)) * 0.3).astype(np.float32)
        self.inner = np.zeros((WIDTH + 1, vocabulary.size), np.float32)
        self.inner[WIDTH] = vocabulary.inner_bias
        self.squares = [np.full(n, 1e-3, np.float32) for n in (vocabulary.size + 1, vocabulary.size)]
        self.met = [np.zeros(n, np.float32) for n in (vocabulary.size + 1, vocabulary.size)]

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        flat = self.dense if flat is None else flat
        return [flat[a:b].reshape(s) for a, b, s in zip(self.edges, self.edges[1:], self.shapes, strict=False)]

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.edges, out.shapes = self.edges, self.shapes
        out.dense, out.dense_squares, out.inputs, out.inner = self.dense.copy(), self.dense_squares.copy(), self.inputs.copy(), self.inner.copy()
        out.squares = [x.copy() for x in self.squares]
        out.met = [np.zeros_like(x) for x in self.met]
        return out

    def sums(self, seen: int) -> dict[int, np.ndarray]:
        """What adds up over copies, by block: weights times what they count for, and that."""
        weight = np.float64(seen)
        out = {0: np.concatenate([self.dense * weight, self.dense_squares * weight, [weight]])}
        at = 1
        for rows, squares, met in zip((self.inputs, self.inner.T), self.squares, self.met, strict=True):
            for low in range(0, len(rows), ROW_BLOCK):
                m = met[low : low + ROW_BLOCK].astype(np.float64)
                if m.any():
                    out[at] = np.c_[rows[low : low + ROW_BLOCK] * m[:, None], squares[low : low + ROW_BLOCK] * m, m].ravel()
                at += 1
        return out

    def mean(self, sums: dict[int, np.ndarray]) -> Network:
        """The average of copies whose ``sums`` are added up; rows that none of them moved stay."""
        out = self.copy()
        if 0 in sums:
            both = sums[0][:-1] / sums[0][-1]
            out.dense, out.dense_squares = (x.astype(np.float32) for x in np.split(both, 2))
        at = 1
        for rows, squares in zip((out.inputs, out.inner.T), out.squares, strict=True):
            for low in range(0, len(rows), ROW_BLOCK):
                if at in sums:
                    part = slice(low, min(low + ROW_BLOCK, len(rows)))
                    got = sums[at].reshape(part.stop - low, -1)
                    moved, m = got[:, -1] > 0, np.maximum(got[:, -1:], 1)
                    rows[part] = np.where(moved[:, None], got[:, :-2] / m, rows[part])
                    squares[part] = np.where(moved, got[:, -2] / m[:, 0], squares[part])
                at += 1
        return out


def strung(documents: list[np.ndarray], vocabulary: Vocabulary) -> np.ndarray:
    """Ranks of all documents in a row, with ``REACH`` places beyond the ends before, between and after them."""
    beyond = vocabulary.size
    out = np.full(sum(map(len, documents)) + REACH * (len(documents) + 1), beyond, np.uint16 if beyond < 65536 else np.uint32)
    at = REACH
    for ids in documents:
        out[at : at + len(ids)] = vocabulary.rank[ids]
        at += len(ids) + REACH
    return out


def _weighed(z: np.ndarray, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, their sums by row, the logarithms that the rows of ``z`` add up to); ``z`` is used up.

    A weight over its row's sum is the softmax; the rows are not divided, as what is made of them is smaller.
    Hidden values are 1 at most, so the columns of ``outputs`` bound the exponents; of the two the smaller is read.
    """
    top = None
    if not (np.abs(outputs).sum(0).max() if outputs.size < z.size else max(z.max(), -z.min())) < SAFE:
        top = z.max(1)
        z -= top[:, None]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return z, total, np.log(total) if top is None else np.log(total) + top


def _sums_of_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values of ``index``, sums of their rows, how many)."""
    order = np.argsort(index, kind="stable")
    found = index[order].astype(np.int64)
    first = np.flatnonzero(np.diff(found, prepend=-1))
    return found[first], np.add.reduceat(rows.take(order, 0), first, axis=0), np.diff(first, append=len(index))


def window_logs(net: Network, vocabulary: Vocabulary, seq: np.ndarray, learn: float = 0.0) -> np.ndarray:
    """log P of every place but the ``REACH`` at each end, by the places around; 0 for those beyond an end.

    With ``learn`` the network is moved by one step at that rate, in place.
    """
    mixing, bias, outputs = net.parts()
    n, width, classes, edges = len(seq) - 2 * REACH, WIDTH, vocabulary.classes, vocabulary.edges
    e = net.inputs.take(seq, 0)
    sides = [slice(REACH + s, REACH + s + n) for s in SIDES]
    h = np.ones((n, width + 1), np.float32)
    mixed = e[sides[0]] @ mixing[0]
    for k in range(1, len(SIDES)):
        mixed += e[sides[k]] @ mixing[k]
    mixed += bias
    # tanh(x) is 1 - 2 / (exp(2 x) + 1); an exponential that overflows gives 1.
    mixed *= 2
    with np.errstate(over="ignore"):
        np.exp(mixed, out=mixed)
    mixed += 1
    np.divide(-2, mixed, out=mixed)
    np.add(mixed, 1, out=h[:, :width])
    # Places in the order of their classes; those beyond an end come last.
    target = seq[REACH : REACH + n]
    of = vocabulary.of[target]
    order = np.argsort(of, kind="stable")
    h, of, target = h.take(order, 0), of[order], target[order]
    cuts = np.searchsorted(of, np.arange(classes + 1))
    real, place = int(cuts[-1]), np.arange(n)
    h, of, target = h[:real], of[:real], target[:real]
    z = h @ outputs
    logs = z[place[:real], of]
    g, total, base = _weighed(z, outputs)
    logs -= base
    if learn:
        g[place[:real], of] -= total
        share = (1 / total)[:, None]
        back = g @ outputs[:width].T
        back *= share
        moves = np.zeros_like(net.dense)
        d_mixing, d_bias, d_outputs = net.parts(moves)
        np.matmul((h * share).T, g, out=d_outputs)
    for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(edges) > 1)).tolist():
        low, high, at = edges[k], edges[k + 1], slice(cuts[k], cuts[k + 1])
        columns, hk, t, here = net.inner[:, low:high], h[at], target[at] - low, place[: cuts[k + 1] - cuts[k]]
        z = hk @ columns
        own = z[here, t]
        g, total, base = _weighed(z, columns)
        own -= base
        logs[at] += own
        if learn:
            g[here, t] -= total
            share = (1 / total)[:, None]
            more = g @ columns[:width].T
            more *= share
            back[at] += more
            slopes = (hk * share).T @ g
            squares = net.squares[1][low:high]
            squares += (slopes * slopes).sum(0) / np.float32(width + 1)
            slopes *= np.float32(learn) / np.sqrt(squares)
            columns -= slopes
            net.met[1][low:high] += len(here)
    out = np.zeros(n, np.float32)
    out[order[:real]] = logs
    if not learn:
        return out
    back -= back * h[:, :width] ** 2
    d_bias[:] = np.ones(real, np.float32) @ back
    placed = np.zeros((n, width), np.float32)
    placed[order[:real]] = back
    around = np.zeros_like(e)
    for k, s in enumerate(sides):
        np.matmul(e[s].T, placed, out=d_mixing[k])
        around[s] += placed @ mixing[k].T
    net.dense_squares += moves * moves
    net.dense -= np.float32(learn) * moves / np.sqrt(net.dense_squares)
    rows, slopes, times = _sums_of_rows(seq, around)
    net.squares[0][rows] += (slopes * slopes).sum(1) / np.float32(width)
    net.inputs[rows] -= slopes * (np.float32(learn) / np.sqrt(net.squares[0][rows]))[:, None]
    net.met[0][rows] += times
    return out


def document_scores(net: Network, vocabulary: Vocabulary, documents: list[np.ndarray]) -> np.ndarray:
    """Summed conditional log-probabilities of each document's ids."""
    seq = strung(documents, vocabulary)
    n = len(seq) - 2 * REACH
    logs = np.zeros(max(n, 0) + REACH, np.float64)
    for at in range(0, n, STEP_TOKENS):
        end = min(n, at + STEP_TOKENS)
        logs[at:end] = window_logs(net, vocabulary, seq[at : end + 2 * REACH])
    ends = np.cumsum([len(x) + REACH for x in documents])
    return np.array([logs[b - len(x) - REACH : b - REACH].sum() for x, b in zip(documents, ends.tolist(), strict=True)])


class Learner:
    """One shard's copy of the network, which gets its documents in turn."""

    def __init__(self, net: Network, vocabulary: Vocabulary, turn: int, rounds: int):
        self.net, self.vocabulary, self.turn, self.rounds = net.copy(), vocabulary, turn, rounds
        self.waiting: list[np.ndarray] = []
        self.left, self.step, self.seen = np.full(REACH, vocabulary.size, strung([], vocabulary).dtype), 0, 0
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids) + REACH
        if self.held >= 16 * STEP_TOKENS:
            self._run(last=False)

    def _run(self, last: bool) -> None:
        seq = np.concatenate([self.left, strung(self.waiting, self.vocabulary)[REACH:]])
        self.waiting, self.held, at = [], 0, 0
        # A stretch and the places that its last window reaches are there, or nothing more comes.
        while len(seq) - at >= STEP_TOKENS + 2 * REACH or last and len(seq) - at > 2 * REACH:
            stretch = seq[at : at + STEP_TOKENS + 2 * REACH]
            if self.step % self.rounds == self.turn:
                window_logs(self.net, self.vocabulary, stretch, RATE)
                self.seen += int((stretch[REACH:-REACH] < self.vocabulary.size).sum())
            self.step += 1
            at += STEP_TOKENS
        self.left = seq[at:]

    def sums(self) -> dict[int, np.ndarray]:
        self._run(last=True)
        return self.net.sums(self.seen) if self.seen else {}


def encoded(docs: DataFrame, vocab: str, shards: int) -> DataFrame:
    """doc_id, shard and ids, unsigned 16 bits each (32 where the vocabulary needs them), in order inside each shard.

    A null text is empty; texts without tokens are dealt anywhere.
    """
    kind = id_type(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = tokens.encoder(vocab).column(batch.column("text"))
            data = ids.astype(kind)
            # A batch of text is far below the 2 GB that its offsets reach.
            found = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), found], ["doc_id", "key", "ids"])

    text = F.col("text").cast("string")
    doc = F.col("doc_id").cast("long")
    key = F.when(F.length(text) > 0, F.xxhash64(text, doc)).otherwise(F.monotonically_increasing_id())
    rows = docs.select(doc.alias("doc_id"), key.alias("key"), text.alias("text")).mapInArrow(encode, "doc_id long, key long, ids binary")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "ids").select("doc_id", "shard", "ids")


def vocabulary_size(vocab: str) -> int:
    return max(tokens.encoder(vocab).tokenizer.get_vocab().values()) + 1


def id_type(vocab: str) -> str:
    return "<u2" if vocabulary_size(vocab) <= 65536 else "<u4"


def count_ids(table: DataFrame, vocab: str) -> dict[int, int]:
    """Occurrences of every id in all documents: at most as many rows as the vocabulary has ids."""
    kind, size = id_type(vocab), vocabulary_size(vocab)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch["ids"]), kind), minlength=size)
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"id": seen, "n": n[seen]})

    counted = table.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def improve(spark: SparkSession, table: DataFrame, vocab: str, vocabulary: Vocabulary, net: Network, turn: int, rounds: int) -> Network:
    """One round: every shard trains a copy on its documents, and the copies are averaged.

    A file of ``table`` holds whole shards one after another in one row group, so a task sees them whole.
    """
    kind = id_type(vocab)

    def packed(sums: dict[int, np.ndarray], part: int) -> pd.DataFrame:
        return pd.DataFrame({"block": list(sums), "part": part, "sums": [x.astype(np.float32).tobytes() for x in sums.values()]})

    def merge(into: dict[int, np.ndarray], more: dict[int, np.ndarray]) -> None:
        for k, v in more.items():
            into[k] = into[k] + v if k in into else v

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        shard, learner = -1, None
        for batch in batches:
            for of, raw in zip(batch["shard"].tolist(), batch["ids"], strict=True):
                if of != shard:
                    if learner:
                        merge(total, learner.sums())
                    shard, learner = of, Learner(net, vocabulary, turn, rounds)
                if raw:
                    learner.add(np.frombuffer(raw, kind))
        if learner:
            merge(total, learner.sums())
        if total:
            yield packed(total, shard % ADDERS)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch["block"].tolist(), batch["sums"], strict=True):
                merge(total, {block: np.frombuffer(raw, np.float32).astype(np.float64)})
        if total:
            yield packed(total, 0)

    schema = "block long, part long, sums binary"
    with shared.one_thread(spark):
        copies = table.select("shard", "ids").mapInPandas(local, schema)
    halfway = copies.repartition(ADDERS, "part").mapInPandas(add, schema)
    rows = halfway.repartition("block").mapInPandas(add, schema).collect()
    return net.mean({r["block"]: np.frombuffer(r["sums"], np.float32).astype(np.float64) for r in rows})


def score(spark: SparkSession, docs: DataFrame, vocab: str = tokens.DEFAULT_VOCAB, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and per_token, a row for each row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens, a log_likelihood of 0 and a null per_token. Repeated rows count and
    are scored each, as are rows with a null doc_id; an empty table gives no rows; other columns are ignored.
    """
    shared.text_batches(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("n")).first()["n"]
    table = shared.save(spark, encoded(docs, vocab, max(1, -(-size // SHARD_BYTES))), "ids")
    vocabulary = Vocabulary(count_ids(table, vocab), vocabulary_size(vocab))
    net = Network(vocabulary)
    for turn in range(rounds):
        net = improve(spark, table, vocab, vocabulary, net, turn, rounds)
    kind = id_type(vocab)

    def rate(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            ids = [np.frombuffer(x, kind) for x in batch["ids"]]
            total = document_scores(net, vocabulary, ids).tolist()
            yield {
                "doc_id": batch["doc_id"], "n_tokens": [len(x) for x in ids], "log_likelihood": total,
                "per_token": [t / len(x) if len(x) else None for t, x in zip(total, ids, strict=True)],
            }

    with shared.one_thread(spark):
        return shared.map_columns(table.select("doc_id", "ids"), rate, "doc_id long, n_tokens long, log_likelihood double, per_token double")
