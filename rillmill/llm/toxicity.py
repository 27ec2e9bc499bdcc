"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a list of common insults together with words and word stems
that labelled rows show to be toxic. Lexicon, trees and calibration are
cross-fitted, so that none is fitted on what another has already seen.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.linear import labelled
from rillmill.llm.shared import sheltered
from rillmill.llm.textnum import Chars, Words, chunks, mix64, word_hash

SAMPLE_ROWS = 12000
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
STEM = 6
FOLDS = 3
LEAST_TOXIC, LEAST_ODDS = 4, 6.0
INSULTS = """
idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass fool fools loser losers clown clowns
trash garbage scum vermin filth filthy pathetic worthless disgusting repulsive vile pig pigs rat cockroach parasite
parasites degenerate degenerates subhuman freak freaks creep creeps jerk jerks bastard bastards bitch asshole dickhead
shit crap fuck fucking damn retard retarded hate kill die ugly nasty lunatic psycho coward cowards liar liars
dummkopf idioten abschaum arschloch schwachkopf trottel versager widerlich connard imbécile crétin abruti ordure
salaud dégoûtant idiota imbécil estúpido basura asqueroso cabrón payaso tonto
""".split()
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú tus vosotros".split()
FEATURES = (
    "words", "insults", "learned", "stems", "hits", "second_person", "proximity", "capitals", "shouts", "punctuation", "obfuscated", "mixed", "stretched",
)
_LOWER = np.array([ord(chr(i).lower()) if len(chr(i).lower()) == 1 else i for i in range(0x3001)], dtype=np.uint32)
_UPPER = np.array([chr(i).isupper() for i in range(0x3001)])
_ALPHA = np.array([chr(i).isalpha() for i in range(0x3001)])
_LEET = _LOWER.copy()
for a, b in zip("013457@$!", "oieastasi"):
    _LEET[ord(a)] = ord(b)


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in words], dtype=np.uint64))


_INSULTS, _SECOND = _hashes(INSULTS), _hashes(SECOND_PERSON)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), dtype=bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _tokens(texts: list) -> tuple[Chars, Words, np.ndarray]:
    """The texts as they are, their lower-case words, and code points clipped to the tables."""
    raw = Chars(texts, lower=False)
    at = np.minimum(raw.cp, 0x3000)
    low = Chars([])
    low.off, low.cp = raw.off, np.where(raw.cp <= 0x3000, _LOWER[at], raw.cp).astype(np.uint32)
    return raw, Words(low, raw.not_alnum()), at


def dense(texts: list, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; all zero for an empty one. words and stems: sorted hashes of the learned lexicon."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in chunks(texts):
        raw, w, at = _tokens(texts[lo:hi])
        cp, nd = raw.cp, hi - lo
        ok = raw.cp <= 0x3000
        n_words, n_chars = np.maximum(w.counts(), 1), np.maximum(np.diff(raw.off), 1)

        def per_doc(mask: np.ndarray, w: Words = w) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[w.off[1:]] - total[w.off[:-1]]).astype(float)

        plain = _among(w.hash, _INSULTS)
        learned = _among(w.hash, words)
        stem = _among(w.prefix_hash(STEM), stems)
        second = _among(w.hash, _SECOND)
        hit = plain | learned
        leet = Chars([])
        leet.off, leet.cp = raw.off, np.where(ok, _LEET[at], cp).astype(np.uint32)
        joiner = (cp == 0x2A) | (cp == 0x5F) | (cp == 0x2D) | (cp == 0x2E)
        spelled = Words(leet, raw.not_alnum() & (leet.cp == np.where(ok, _LOWER[at], cp)))
        disguised = _among(spelled.hash, _INSULTS) | _among(spelled.hash, words)
        alpha = _ALPHA[at] | ~ok
        digit = ok & (cp >= 48) & (cp <= 57)
        inner = np.zeros(len(cp), dtype=bool)
        same = np.zeros(len(cp), dtype=bool)
        if len(cp) > 2:
            inner[1:-1] = (digit | joiner)[1:-1] & alpha[:-2] & alpha[2:]
            same[2:] = alpha[2:] & (cp[2:] == cp[1:-1]) & (cp[2:] == cp[:-2])
        near = np.zeros(nd)
        you, hits, doc = np.flatnonzero(second), np.flatnonzero(hit | stem), w.doc()
        if len(you) and len(hits):
            for side in (np.searchsorted(you, hits) - 1, np.searchsorted(you, hits)):
                valid = (side >= 0) & (side < len(you))
                y = you[np.clip(side, 0, len(you) - 1)]
                valid &= doc[y] == doc[hits]
                np.maximum.at(near, doc[hits[valid]], 1 / (1 + np.abs(y - hits)[valid]))
        o = out[lo:hi]
        o[:, 0] = np.log1p(w.counts())
        o[:, 1] = 100 * per_doc(plain) / n_words
        o[:, 2] = 100 * per_doc(learned) / n_words
        o[:, 3] = 100 * per_doc(stem) / n_words
        o[:, 4] = np.log1p(per_doc(hit))
        o[:, 5] = 100 * per_doc(second) / n_words
        o[:, 6] = near
        o[:, 7] = raw.sums(_UPPER[at] & ok) / n_chars
        o[:, 8] = 100 * raw.sums((cp == 0x21) | (cp == 0x3F)) / n_chars
        o[:, 9] = 100 * raw.sums(raw.not_alnum() & ~raw.spaces()) / n_chars
        o[:, 10] = 100 * np.maximum(per_doc(disguised, spelled) - per_doc(hit), 0) / n_words
        o[:, 11] = 100 * raw.sums(inner) / n_words
        o[:, 12] = 100 * raw.sums(same) / n_words
        o[w.counts() == 0] = 0
    return out


def vocabulary(texts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words and for stems: the sorted hashes, and each (place of the hash, document) in which one occurs."""
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for lo, hi in chunks(texts):
        _, w, _ = _tokens(texts[lo:hi])
        doc = w.doc()
        for k, h in enumerate((w.hash, w.prefix_hash(STEM))):
            known, row = np.unique(h, return_inverse=True)
            pair = np.unique(row.astype(np.int64) * (hi - lo) + doc)
            seen[k].append((known[pair // (hi - lo)], pair % (hi - lo) + lo))
    out = []
    for parts in seen:
        h = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
        known, row = np.unique(h, return_inverse=True)
        out.append((known, row, np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])))
    return out


def learn_lexicon(vocabularies: list, y: np.ndarray, rows: np.ndarray, least: int = LEAST_TOXIC, odds: float = LEAST_ODDS) -> list[np.ndarray]:
    """Of words, and of stems, the hashes whose share of toxic documents is at least ``odds`` times that of the others, in ``least`` toxic documents or more; only documents in ``rows`` count."""
    out = []
    toxic_rows, other_rows = rows & (y > 0), rows & (y <= 0)
    pos, neg = max(toxic_rows.sum(), 1), max(other_rows.sum(), 1)
    for known, row, doc in vocabularies:
        toxic = np.bincount(row[toxic_rows[doc]], minlength=len(known))
        other = np.bincount(row[other_rows[doc]], minlength=len(known))
        out.append(known[(toxic >= least) & (toxic / pos > odds * (other + 0.5) / neg)])
    return out


class Trees:
    """Boosted complete trees of fixed depth on binned features; logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.depth = depth
        self.cuts = [np.zeros(1)] * x.shape[1] if not len(y) else [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        for f, c in enumerate(self.cuts if len(y) else ()):
            if len(c) < 4:  # a feature that is mostly zero is cut by its other values
                v = x[x[:, f] > 0, f]
                self.cuts[f] = np.unique(np.concatenate([c, [0.0], np.quantile(v, np.linspace(0, 0.9, 10)) if len(v) else []]))
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        q, z, nf = self._bin(x), np.full(len(y), self.base), x.shape[1]
        width = max(len(c) for c in self.cuts) + 1
        for _ in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feat, cut, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width), np.zeros(len(y), np.int64)
            for level in range(depth):
                k, first = 2**level, 2**level - 1
                key = ((node * nf)[:, None] + np.arange(nf)) * width + q
                gs, hs = (np.bincount(key.ravel(), np.repeat(v, nf), minlength=k * nf * width).reshape(k, nf, width).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                best = gain.reshape(k, -1).argmax(1)
                useful = gain.reshape(k, -1).max(1) > 1e-6
                feat[first : first + k] = best // width
                cut[first : first + k] = np.where(useful, best % width, width)
                node = 2 * node + (q[np.arange(len(y)), feat[first + node]] > cut[first + node])
            value = rate * np.bincount(node, g, minlength=2**depth) / (np.bincount(node, h, minlength=2**depth) + 1)
            self.trees.append((feat, cut, value))
            z += value[node]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        q, rows = self._bin(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (q[rows, feat[at]] > cut[at])
            z += value[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means of y, non-decreasing in z, at the blocks' middle scores."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(z[order], y[order].astype(float)):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """The lexicon comes from all rows; every row that trees and calibration learn from has features by a lexicon, and a score by trees, that haven't seen it."""

    def __init__(self, texts: list, y: np.ndarray):
        part = np.arange(len(y)) % FOLDS
        pick = lambda rows: [t for t, r in zip(texts, rows) if r]
        x, z, known = np.zeros((len(y), len(FEATURES))), np.zeros(len(y)), vocabulary(texts)
        for k in range(FOLDS):
            x[part == k] = dense(pick(part == k), *learn_lexicon(known, y, part != k))
        for k in range(FOLDS):
            z[part == k] = Trees(x[part != k], y[part != k]).log_odds(x[part == k])
        self.words, self.stems = learn_lexicon(known, y, part >= 0)
        self.trees = Trees(x, y)
        self.steps = isotonic(z, y)

    def probability(self, texts: list) -> np.ndarray:
        z = self.trees.log_odds(dense(texts, self.words, self.stems))
        return np.interp(z, *self.steps)


def train(docs: DataFrame, labels: DataFrame, cap: int = SAMPLE_ROWS) -> bytes | None:
    """The pickled model, fitted in one task of an executor on at most about ``cap`` labelled rows; None without any."""

    def run(batches):
        ids, texts, y = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
            texts += b.column(2).to_pylist()
        if ids:
            ids_, y_ = np.array(ids, dtype=np.int64), np.array(y, dtype=float)
            order = np.lexsort((ids_, mix64(ids_.view(np.uint64))))
            m = Model([texts[i] for i in order], y_[order])
            yield pa.RecordBatch.from_pydict({"m": pa.array([pickle.dumps(m)], pa.binary())})

    got = labelled(docs, labels, "toxic", cap).repartition(1).mapInArrow(run, "m binary").collect()
    return bytes(got[0]["m"]) if got else None


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, probability) for every row of docs.

    Null, blank or wordless texts have probability 0. Whole texts are scored, however long. Rows with null ids are
    scored like others, repeated rows give repeated rows and equal texts equal probabilities, an empty table gives
    an empty result; without labels every probability is 0. A word joins the lexicon if at least ``LEAST_TOXIC`` toxic
    documents of the sample hold it, so with few labels the lexicon is the list of insults. Of equal gains a tree takes
    the first feature and the lowest cut. Columns beside doc_id and text are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(batches):
        m = pickle.loads(shared.value) if shared.value else None
        for b in batches:
            texts = b.column(1).to_pylist()
            p = np.round(m.probability(texts), 6) if m and texts else np.zeros(len(texts))
            p[[not t or not any(map(str.isalnum, t)) for t in texts]] = 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "probability"])

    return sheltered(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, probability double")


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **params) -> DataFrame:
    """The rows whose calibrated probability is at least ``threshold``; see ``score_toxicity``."""
    return score_toxicity(docs, labels, **params).where(F.col("probability") >= threshold)
