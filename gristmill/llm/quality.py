"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potentials come from its own features and
from those of the lines before and after it; neighbouring labels have
transition weights. Forward-backward marginals, weighted by the lines'
lengths, give the share of a document that is good, and a logistic curve
fitted on the training documents turns that share into the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bound of the fit: labelled documents of each label, and characters of a document for it to be among them.
FIT_ROWS = 1500
FIT_CHARS = 20_000
STEPS, RATE, DECAY = 120, 0.08, 1e-3

# Classes of bytes that are counted in each line.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "other": bytes(range(128, 256))}
LOOKUP = np.full(256, len(CLASSES), np.int64)
for _i, _b in enumerate(CLASSES.values()):
    LOOKUP[np.frombuffer(_b, np.uint8)] = _i
OWN = 14


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, the lines' lengths, lines of each text); a text has one line at least."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    n = int(counts.sum())
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    k = len(CLASSES) + 1
    newline = raw == 10
    of = np.cumsum(newline) - newline
    by = np.bincount((of * k + LOOKUP[raw])[~newline], minlength=n * k).reshape(n, k).astype(np.float32)
    size = by.sum(1)
    share = by / np.maximum(size, 1)[:, None]
    # Symbols, the last class, and words: how many, how many different ones.
    words = np.empty((n, 2), np.float32)
    i = 0
    for doc in lines:
        for line in doc:
            w = line.split()
            words[i] = len(w), len(set(w))
            i += 1
    kinds = np.where(words[:, 0] > 0, words[:, 1] / np.maximum(words[:, 0], 1), 1.0)
    letters = np.maximum(by[:, 0] + by[:, 1] + by[:, 7], 1)
    out = np.empty((n, OWN), np.float32)
    out[:, :9] = share
    out[:, 9] = by[:, 1] / letters
    out[:, 10] = np.log1p(size) / 8
    out[:, 11] = np.minimum(kinds * np.log1p(words[:, 0]) / 4, 2)
    out[:, 12] = kinds
    out[:, 13] = np.minimum(size / np.maximum(words[:, 0], 1) / 20, 2)
    return out, np.maximum(size, 1), counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line after (0 beyond the document), and three biases."""
    n = len(own)
    out = np.zeros((n, 3 * own.shape[1] + 3), np.float32)
    first = np.zeros(n, bool)
    first[np.cumsum(counts) - counts] = True
    last = np.zeros(n, bool)
    last[np.cumsum(counts) - 1] = True
    f = own.shape[1]
    out[:, :f] = own
    out[1:, f : 2 * f][~first[1:]] = own[:-1][~first[1:]]
    out[:-1, 2 * f : 3 * f][~last[:-1]] = own[1:][~last[:-1]]
    out[:, 3 * f :] = np.stack([np.ones(n), first, last], 1)
    return out


def forward_backward(unary: np.ndarray, counts: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions), from the good label's potentials; all chains at once.

    Transitions count by ``weight``, that of the line after.
    """
    weight = np.ones(len(unary)) if weight is None else weight
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    grow = np.exp(trans)
    n = len(unary)
    pot = np.ones((n, 2))
    pot[:, 1] = np.exp(np.clip(unary, -30, 30))
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    a = pot[starts] / pot[starts].sum(1, keepdims=True)
    alpha[starts] = a
    for t in range(1, longest):
        at = starts[: active[t]] + t
        a = (a[: active[t]] @ grow) * pot[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        w = beta[at] * pot[at]
        joint = alpha[at - 1][:, :, None] * grow[None] * w[:, None, :]
        pairs += (joint * (weight[at] / joint.sum((1, 2)))[:, None, None]).sum(0)
        b = w @ grow.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs


class Model:
    """Weights of the field, and of the curve over the good share."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, curve: tuple[float, float]):
        self.weights, self.trans, self.curve = weights, trans, curve

    def good_shares(self, texts: list[str]) -> np.ndarray:
        own, size, counts = line_features(texts)
        p, _ = forward_backward(with_neighbours(own, counts) @ self.weights, counts, self.trans)
        ends = np.cumsum(counts) - counts
        return np.add.reduceat(p * size, ends) / np.add.reduceat(size, ends)

    def scores(self, texts: list[str]) -> np.ndarray:
        share = np.clip(self.good_shares(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(share / (1 - share)) + self.curve[1])))


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Fit on labelled texts; every line starts with its document's label.

    Half-way, lines of bad documents that the field takes for good keep that label, as junk is often only
    part of a document. Without both labels every score is the known label, or 0.5.
    """
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        level = 20.0 * (2 * y[0] - 1) if len(y) else 0.0
        return Model(np.zeros(3 * OWN + 3), np.zeros((2, 2)), (0.0, level))
    own, size, counts = line_features(texts)
    x = with_neighbours(own, counts).astype(np.float64)
    of_line = np.repeat(y, counts)
    target = of_line.copy()
    # Both labels weigh the same, and a document's lines together.
    weight = np.repeat(1 / counts * np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), counts)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - counts] = False
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        p, pairs = forward_backward(x @ w, counts, trans, weight)
        if step == steps // 2:
            target = np.where((of_line == 0) & (p > 0.8), 1.0, of_line)
        seen = np.zeros((2, 2))
        np.add.at(seen, (target[:-1].astype(int)[inner[1:]], target[1:].astype(int)[inner[1:]]), weight[1:][inner[1:]])
        gradient = np.concatenate([x.T @ ((target - p) * weight) - DECAY * w, (seen - pairs).ravel() - DECAY * trans.ravel()])
        m1 = 0.9 * m1 + 0.1 * gradient
        m2 = 0.999 * m2 + 0.001 * gradient**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w += move[:-4]
        trans += move[-4:].reshape(2, 2)
    model = Model(w, trans, (1.0, 0.0))
    share = np.clip(model.good_shares(texts), 1e-4, 1 - 1e-4)
    z = np.log(share / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(2000):
        q = 1 / (1 + np.exp(-(a * z + b)))
        a += 0.1 * np.mean((y - q) * z)
        b += 0.3 * np.mean(y - q)
    return Model(w, trans, (max(a, 1e-3), b))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """Train on at most ``rows`` documents of each label whose ids hash least and that have ``chars`` characters at most.

    Labels other than 0 and 1, documents that are labelled both ways and null texts are left out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.where(F.col("quality") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    both = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), "quality"))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= chars)).join(both, F.col("doc_id") == F.col("_id"))
    found = sorted((r["_id"], r["text"], r["quality"]) for r in texts.select("_id", "text", "quality").collect())
    return train([t for _, t, _ in found], [q for _, _, q in found])


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; null texts count as empty, and these have the score of an empty line."""
    shared.text_batches(spark)

    def rate(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        for batch in batches:
            if batch["text"]:
                yield {"doc_id": batch["doc_id"], "score": model.scores([t or "" for t in batch["text"]])}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shared.map_columns(rows, rate, "doc_id long, score double")


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of rows whose remainder modulo 3 is 1 are never read."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = fit(docs, labels.where(fold != 1))
    rows = score(spark, docs, model)
    return rows.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
