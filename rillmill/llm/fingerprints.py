"""Document fingerprints by consistent weighted sampling.

Each sample keeps one (term, level) of the document such that two documents
agree in a sample with probability equal to their generalised Jaccard
similarity, sum of minima over sum of maxima of the term counts (Ioffe's
scheme: r, c ~ Gamma(2, 1), b ~ U(0, 1) for each term and sample;
t = floor(ln w / r + b), ln y = r (t - b), the term with the least
ln c - ln y - r is taken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.shared import sheltered
from rillmill.llm.textnum import Chars, Words, chunks, mix64

SAMPLES = 64
_SEED = 0x6A09E667F3BCC908
_CHUNK = 1 << 20


def term_parameters(term: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b for each term hash and sample, the same wherever the term occurs."""
    k = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(_SEED | 1))
    base = term[:, None] ^ k[None, :]
    x, y, z = (mix64(base * np.uint64(m)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

    def unit(bits: np.ndarray) -> np.ndarray:
        return (bits.astype(np.uint32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)

    high = np.uint64(32)
    r = -np.log(unit(x)) - np.log(unit(x >> high))
    c = np.log(-np.log(unit(y)) - np.log(unit(y >> high)))
    return np.maximum(r, np.float32(1e-6)), c, np.minimum(unit(z >> high), np.float32(0.9999999))


def signatures(texts: list, samples: int = SAMPLES) -> list:
    """One array of ``samples`` 32-bit integers for each text, None where it has no words."""
    out: list = [None] * len(texts)
    for lo, hi in chunks(texts, _CHUNK):
        ch = Chars(texts[lo:hi])
        w = Words(ch, ch.not_alnum())
        if not len(w.hash):
            continue
        term, row = np.unique(w.hash, return_inverse=True)
        key, count = np.unique(w.doc() * len(term) + row, return_counts=True)
        doc, row = key // len(term), key % len(term)
        bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
        r, c, b = (np.empty((len(term), samples), np.float32) for _ in range(3))
        for s in range(0, len(term), 2048):
            r[s : s + 2048], c[s : s + 2048], b[s : s + 2048] = term_parameters(term[s : s + 2048], samples)
        once = c + r * b - r
        log_count = np.log(count.astype(np.float32))
        across = np.arange(samples)
        for d in range(hi - lo):
            i, j = bounds[d], bounds[d + 1]
            if i == j:
                continue
            rows = row[i:j]
            cost = once[rows]
            many = np.flatnonzero(count[i:j] > 1)
            level = np.zeros((0, samples), np.float32)
            if len(many):
                rm, bm = r[rows[many]], b[rows[many]]
                level = np.floor(log_count[i:j][many, None] / rm + bm)
                cost[many] = c[rows[many]] - rm * (level - bm) - rm
            best = cost.argmin(axis=0)
            t = np.zeros(samples, np.int64)
            if len(many):
                at = np.searchsorted(many, best)
                at = np.minimum(at, len(many) - 1)
                hit = many[at] == best
                t[hit] = level[at[hit], across[hit]].astype(np.int64)
            sig = mix64(term[rows[best]] + t.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            out[lo + d] = (sig >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def document_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, signature) for every row of docs; the share of equal places of two signatures estimates the generalised Jaccard similarity of their term counts.

    Terms are lower-case runs of letters and digits. A null text or one without
    terms has a null signature; null ids and repeated rows are kept as they
    are; equal texts have equal signatures, and of terms with equal samples the first by hash is taken; whole texts count, however long; an empty table gives an empty result. Columns beside doc_id and
    text are not read, whatever their names.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signatures(b.column(1).to_pylist(), samples), pa.list_(pa.int32()))], ["doc_id", "signature"])

    return sheltered(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, signature array<int>")
