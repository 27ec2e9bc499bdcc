"""Logistic regression on hashed word and character n-grams.

Shared by the quality rules and the empirical-Bayes classifier. Features are
relative frequencies: for each family (words, word pairs, characters by 3 and
by 5) the mean weight over the document's n-grams, so a score needs one table look-up for each
n-gram and a cumulative sum, and no sorting or dictionaries. A pair of equal
words is one feature whatever the word is, which shows texts that repeat
themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.shared import lean, sheltered
from rillmill.llm.textnum import Chars, Words, chunks

BITS = 16
_D = 1 << BITS
FAMILIES = ("word", "pair", "char3", "char5")
SIZE = len(FAMILIES) * _D
LEAST_ROWS = 10


def features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: bucket of each n-gram and the bounds (lo, hi) of each document's n-grams."""
    ch = Chars(texts)
    w = Words(ch)
    out = []
    word = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    out.append((word, np.stack([w.off[:-1], w.off[1:]])))
    if len(w.hash) > 1:
        same = w.hash[:-1] == w.hash[1:]
        pair = ((w.hash[:-1] * np.uint64(3) + w.hash[1:]) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - BITS)
        pair = np.where(same, np.uint64(0), pair).astype(np.int64)
    else:
        pair = np.zeros(0, dtype=np.int64)
    out.append((pair + _D, np.stack([np.minimum(w.off[:-1], len(pair)), np.minimum(np.maximum(w.off[1:] - 1, w.off[:-1]), len(pair))])))
    for k, n in ((2, 3), (3, 5)):
        g = (ch.grams(n) >> np.uint32(32 - BITS)).astype(np.int64) + k * _D
        lo = np.minimum(ch.off[:-1], len(g))
        out.append((g, np.stack([lo, np.maximum(np.minimum(ch.off[1:] - n + 1, len(g)), lo)])))
    return out


def score(weights: np.ndarray, bias: float, texts: list) -> np.ndarray:
    """Log-odds of each text; an empty or missing text gets the bias."""
    z = np.full(len(texts), bias)
    for lo, hi in chunks(texts):
        part = np.zeros(hi - lo)
        for bucket, (a, b) in features(texts[lo:hi]):
            total = np.zeros(len(bucket) + 1)
            np.cumsum(weights[bucket], out=total[1:])
            part += (total[b] - total[a]) / np.maximum(b - a, 1)
        z[lo:hi] += part
    return z


def sparse(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the features, for training."""
    docs, idx, val = [], [], []
    for lo, hi in chunks(texts):
        for bucket, (a, b) in features(texts[lo:hi]):
            n = b - a
            doc = np.repeat(np.arange(hi - lo), n)
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(doc))
            key, count = np.unique(doc * SIZE + bucket[at], return_counts=True)
            d = key // SIZE
            docs.append((d + lo).astype(np.int32))
            idx.append((key % SIZE).astype(np.int32))
            val.append(count / n[d])
    return (np.concatenate(x) if x else np.zeros(0) for x in (docs, idx, val))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the log-odds that fit held-out labels best (Newton steps on Platt's smoothed targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float
    base: float

    def log_odds(self, texts: list) -> np.ndarray:
        """Calibrated log-odds."""
        return self.a * score(self.weights, self.bias, texts) + self.b


def fit(texts: list, y: np.ndarray, rounds: int = 100, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Full-batch Adam on four rows of five; the fifth calibrates. With fewer than LEAST_ROWS rows or one class only, the model says the smoothed base rate, as there is nothing to calibrate with."""
    y = np.asarray(y, dtype=float)
    base = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(base / (1 - base)))
    flat = Model(np.zeros(SIZE, np.float32), prior, 1.0, 0.0, base)
    if len(y) < LEAST_ROWS or y.min() == y.max():
        return flat
    held = np.arange(len(y)) % 5 == 4
    if y[~held].min() == y[~held].max():
        return flat
    train = [t for t, h in zip(texts, held) if not h]
    yt = y[~held]
    doc, idx, val = sparse(train)
    w, m, v = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    bias = prior
    val = val * 4
    for k in range(1, rounds + 1):
        err = (sigmoid(bias + np.bincount(doc, w[idx] * val, minlength=len(yt))) - yt) / len(yt)
        g = np.bincount(idx, err[doc] * val, minlength=SIZE) + decay * w / len(yt)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
        bias -= 0.5 * err.sum()
    weights = (w * 4).astype(np.float32)
    a, b = platt(score(weights, bias, [t for t, h in zip(texts, held) if h]), y[held])
    return Model(weights, bias, a, b, base)


def labelled(docs: DataFrame, labels: DataFrame, label: str, cap: int) -> DataFrame:
    """At most about ``cap`` labelled rows (label, text) by a hash of doc_id, the same ones on every run.

    The rows are drawn from the labels before the join, so the side that is
    broadcast is bounded by ``cap`` and the documents aren't shuffled. Rows with a null id or label are left out;
    of a doc_id with several labels the smallest counts.
    """
    docs, labels = sheltered(docs), sheltered(labels, ("doc_id", label))
    lab = labels.select("doc_id", F.col(label).cast("double").alias("_y")).where("doc_id is not null and _y is not null")
    lab = lab.groupBy("doc_id").agg(F.min("_y").alias("_y"))
    n = lab.count()
    if n > cap:
        lab = lab.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * cap / n))
    return docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(lab), "doc_id").select("doc_id", "_y", "text")


def train(docs: DataFrame, labels: DataFrame, label: str, cap: int) -> Model:
    """Fit on the bounded sample, in one task of an executor; only the weights reach the driver."""

    def run(batches):
        ids, texts, y = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
            texts += b.column(2).to_pylist()
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        m = fit([texts[i] for i in order], np.array(y, dtype=float)[order])
        yield pa.RecordBatch.from_pydict({"w": pa.array([m.weights.tobytes()], pa.binary()), "p": pa.array([[m.bias, m.a, m.b, m.base]], pa.list_(pa.float64()))})

    got = labelled(docs, labels, label, cap).repartition(1).mapInArrow(lean(run), "w binary, p array<double>").collect()
    if not got:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(bytes(got[0]["w"]), dtype=np.float32), *got[0]["p"])
