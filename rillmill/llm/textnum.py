"""Vectorised text arithmetic for Arrow batches.

Texts of a batch are joined into one array of code points, so that words,
word n-grams and character n-grams of thousands of documents are hashed by a
few numpy passes instead of a Python loop for each document. Words are what
``str.lower().split()`` gives; None counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_CHARS = 1 << 19
_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WS = np.zeros(0x3001, dtype=bool)
_WS[_SPACES] = True
_NOT_ALNUM = np.array([not chr(i).isalnum() for i in range(0x3001)])
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        made = []
        for base in (_P, _P_INV):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` characters together, or one longer text alone."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if texts:
        yield lo, len(texts)


class Chars:
    """Code points of the texts, joined; document i is ``cp[off[i]:off[i + 1]]``."""

    def __init__(self, texts: list, lower: bool = True):
        parts = [((t.lower() if lower else t) if t else "") for t in texts]
        self.off = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=self.off[1:])
        self.cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def spaces(self) -> np.ndarray:
        return _WS[np.minimum(self.cp, 0x3000)] & (self.cp <= 0x3000)

    def not_alnum(self) -> np.ndarray:
        """Code points that are neither letters nor digits; those beyond U+3000 count as letters."""
        return _NOT_ALNUM[np.minimum(self.cp, 0x3000)] & (self.cp <= 0x3000)

    def sums(self, values: np.ndarray, n: int = 1) -> np.ndarray:
        """Sum for each document over the n-grams that lie wholly in it; values[i] is that of the n-gram at i."""
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        lo, hi = self.off[:-1], np.maximum(self.off[1:] - n + 1, self.off[:-1])
        hi = np.minimum(hi, len(values))
        return total[hi] - total[np.minimum(lo, hi)]

    def grams(self, n: int) -> np.ndarray:
        """32-bit hash of the n characters that start at each place."""
        m = max(len(self.cp) - n + 1, 0)
        h = np.full(m, (n * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h ^= self.cp[k : k + m]
            h *= np.uint32(0x85EBCA6B + 2 * 0x1234567 * k)
            h ^= h >> np.uint32(15)
        return h


class Words:
    """Words of the texts: ``hash`` for each word; those of document i are ``off[i]:off[i + 1]``.

    ``between`` marks the code points that separate words: white space, if not given.
    """

    def __init__(self, chars: Chars, between: np.ndarray | None = None):
        cp, n = chars.cp, len(chars.cp)
        ws = chars.spaces() if between is None else between
        before = np.ones(n, dtype=bool)
        before[1:] = ws[:-1]
        inner = chars.off[:-1]
        before[inner[inner < n]] = True
        self.start = np.flatnonzero(~ws & before)
        after = np.ones(n, dtype=bool)
        after[:-1] = ws[1:]
        last = chars.off[1:] - 1
        after[last[last >= 0]] = True
        self.end = np.flatnonzero(~ws & after) + 1
        self.off = np.searchsorted(self.start, chars.off)
        pw, inv = _tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * inv[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        self._total, self._inv = total, inv

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hash of the first n characters of each word, as if they were a word; shorter words whole."""
        end = np.minimum(self.end, self.start + n)
        h = (self._total[end] - self._total[self.start]) * self._inv[self.start]
        return mix64(h + (end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, 64-bit hash) of each word n-gram; a document of fewer than n words, but not empty, has one gram of all its words."""
        counts = self.counts()
        doc = self.doc()
        place = np.arange(len(self.hash)) - self.off[:-1][doc]
        left = counts[doc] - place
        whole = (left >= n) | (place == 0)
        at = np.flatnonzero(whole)
        h = np.full(len(at), np.uint64(n * 0x51ED270B), dtype=np.uint64)
        for k in range(n):
            has = left[at] > k
            nxt = np.where(has, self.hash[np.minimum(at + k, len(self.hash) - 1)], np.uint64(0)) if len(at) else h
            h = mix64(h * np.uint64(0x9FB21C651E98DF25) + nxt + np.uint64(k + 1))
        return doc[at], h


def word_hash(word: str) -> int:
    """The hash that Words gives this word."""
    return int(Words(Chars([word])).hash[0])
