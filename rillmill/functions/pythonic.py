"""Functions without a built-in counterpart, as Arrow-batched UDFs. None of them raises on odd input: it gives null or an empty list."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.IntegerType())
def common_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays."""
    return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


def mattr(tokens: list, window: int = 50) -> float:
    """Mean share of different tokens over all windows; of all tokens, if there are fewer; 0 for none.

    A token counts in the windows that hold it, but not the one before of its kind, so one pass is enough.
    """
    n = len(tokens)
    if n == 0:
        return 0.0
    if n < window:
        return len(set(tokens)) / n
    seen: dict = {}
    total = 0
    for i, t in enumerate(tokens):
        total += max(0, min(i, n - window) - max(0, i - window + 1, seen.get(t, -1) + 1) + 1)
        seen[t] = i
    return total / window / (n - window + 1)


@F.pandas_udf(T.DoubleType())
def moving_ttr(tokens: pd.Series) -> pd.Series:
    return pd.Series([0.0 if t is None else mattr(list(t)) for t in tokens], dtype="float64")


def alias_hits(text: Column, aliases: dict[str, list[str]]) -> Column:
    """array<struct<id, raw, start, end>>: every match of every alias, by place; places count characters from 0."""
    known = [(k, re.compile(p)) for k, ps in aliases.items() for p in ps]

    @F.pandas_udf("array<struct<id: string, raw: string, start: int, end: int>>")
    def scan(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return []
            hits = [{"id": k, "raw": m.group(), "start": m.start(), "end": m.end()} for k, p in known for m in p.finditer(t)]
            return sorted(hits, key=lambda h: h["start"])

        return pd.Series([one(t) for t in texts])

    return scan(text)


def folded(text: str) -> str:
    """Composed, lower-case, with single blanks for white space."""
    return " ".join(unicodedata.normalize("NFC", text).lower().split())


def approximate(text: str, pattern: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of each best place where the folded pattern occurs in the folded text with at most ``most`` edits.

    One column of the edit matrix for each character of the text, with the start of
    the alignment carried along; of a run of neighbouring ends the first of least distance is taken.
    """
    return approximate_folded(folded(text), folded(pattern), most)


def approximate_folded(text: str, pattern: str, most: int) -> list[tuple[int, int, int]]:
    """``approximate`` for what is folded already."""
    m = len(pattern)
    if not m:
        return []
    p = np.frombuffer(pattern.encode("utf-32-le"), dtype="<u4")
    at = np.arange(m + 1)
    cost, start = at.copy(), np.zeros(m + 1, dtype=np.int64)
    out: list[tuple[int, int, int]] = []
    best: tuple[int, int, int] | None = None
    for j, c in enumerate(np.frombuffer(text.encode("utf-32-le"), dtype="<u4")):
        swap, skip = cost[:-1] + (p != c), cost[1:] + 1
        take = swap <= skip
        new = np.concatenate([[0], np.where(take, swap, skip)])
        begin = np.concatenate([[j + 1], np.where(take, start[:-1], start[1:])])
        low = np.minimum.accumulate(new - at)  # deletions along the column
        from_ = np.maximum.accumulate(np.where(new - at == low, at, 0))
        cost, start = low + at, begin[from_]
        if cost[m] <= most:
            if best is None or cost[m] < best[2]:
                best = (int(start[m]), j + 1, int(cost[m]))
        elif best:
            out.append(best)
            best = None
    return out + ([best] if best else [])


def approximate_hits(text: Column, pattern: Column, most: Column) -> Column:
    """array<struct<start, end, distance>> of ``approximate``; empty for a null text or pattern."""

    @F.pandas_udf("array<struct<start: int, end: int, distance: int>>")
    def scan(texts: pd.Series, patterns: pd.Series, limits: pd.Series) -> pd.Series:
        rows = [[] if t is None or p is None or pd.isna(k) else approximate(t, p, int(k)) for t, p, k in zip(texts, patterns, limits)]
        return pd.Series([[{"start": s, "end": e, "distance": d} for s, e, d in r] for r in rows])

    return scan(text, pattern, most)


class Quotes:
    """Whole quotes sought in texts at once, with the hits of ``approximate`` for each.

    Pieces of ``q`` characters of a quote, of which an edit breaks one at most: of P pieces all but k are kept by k edits, and these lie on
    diagonals (place in the text less place in the quote) at most k apart. Many texts are read at once for the pieces of all
    quotes, sorted by quote and diagonal. Where P - k of them are near enough, and chain up, the edits of all such places are
    counted side by side, and only quotes that do occur are sought one at a time.
    """

    SLOTS = 1 << 18
    CHUNK = 1 << 18  # characters read at once
    WIDEST = 96  # pieces on near diagonals that are chained; with more, edits are counted at once
    SIDE = 256  # places whose edits are counted side by side

    def __init__(self, quotes: list[tuple[object, str, int]]):
        self.quotes = [(i, folded(p), k) for i, p, k in quotes]

    @cached_property
    def whole(self) -> list[int]:
        """Quotes too short for pieces: each text may have them."""
        return [n for n, (_, p, k) in enumerate(self.quotes) if p and len(p) <= k]

    @cached_property
    def tables(self):
        """For each q, the quotes cut so, with their budgets and numbers of pieces, slot -> pieces as first, count, and each piece as one number (quote, - place, piece)."""
        out, by_q = [], {}
        for n, (_, p, k) in enumerate(self.quotes):
            if len(p) > k:
                by_q.setdefault(min(4, len(p) // (k + 1)), []).append(n)
        for q, ns in sorted(by_q.items()):
            slots = [self.slots(self.codes(self.quotes[n][1]), q) for n in ns]
            often = np.bincount(np.concatenate(slots), minlength=self.SLOTS) / sum(map(len, slots))
            places = [self.pieces(often[s], q, self.quotes[n][2]) for n, s in zip(ns, slots)]
            parts = np.array([len(p) for p in places])
            low, longest = int(parts.max()).bit_length(), max(len(self.quotes[n][1]) for n in ns)
            high = 62 - len(ns).bit_length()
            at = [(int(s[x]), (i << high) + ((longest - x) << low) + j) for i, (s, p) in enumerate(zip(slots, places)) for j, x in enumerate(p)]
            at = np.array(sorted(at), dtype=np.int64).reshape(-1, 2)
            count = np.bincount(at[:, 0], minlength=self.SLOTS)
            out.append((q, np.array(ns), np.array([self.quotes[n][2] for n in ns]), parts, np.cumsum(count) - count, count, at[:, 1], low, high, longest))
        return out

    @staticmethod
    def pieces(often: np.ndarray, q: int, k: int) -> list[int]:
        """Places of the pieces, in order, that don't overlap: of each number of pieces above k the ones that occur least often, and of these numbers the one that chance reaches least."""
        n, most = len(often), (len(often) + q - 1) // q
        cost = np.full((most + 1, n + q), np.inf)  # of j pieces that end before a place
        cost[0] = 0
        for j in range(1, most + 1):
            cost[j, q:] = np.minimum.accumulate(cost[j - 1, :n] + often)
        chance = []
        for j in range(k + 1, most + 1):
            rate, least = cost[j, -1] * 3 * (k + 1), j - k  # diagonals at most k apart, and room for texts that resemble quotes
            chance.append(least * np.log(rate / least) + least - rate if rate < least else 0.0)
        j, x, out = k + 1 + int(np.argmin(chance)), n + q - 1, []
        while j:
            while x > q and cost[j, x - 1] == cost[j, x]:
                x -= 1
            out.append(x - q)
            x, j = x - q, j - 1
        return out[::-1]

    @cached_property
    def masks(self) -> list[dict[str, int]]:
        out = []
        for _, p, _ in self.quotes:
            bits: dict[str, int] = {}
            for i, c in enumerate(p):
                bits[c] = bits.get(c, 0) | 1 << i
            out.append(bits)
        return out

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    @staticmethod
    def slots(codes: np.ndarray, q: int) -> np.ndarray:
        n = max(len(codes) - q + 1, 0)
        h = np.zeros(n, dtype=np.uint32)
        for i in range(q if n else 0):
            h *= np.uint32(0x01000193)
            h ^= codes[i : i + n]
        h *= np.uint32(0x9E3779B1)
        return h >> np.uint32(14)

    def ends(self, n: int, text: str):
        """(end, distance) of each place where the quote may end within its budget, by Myers' bit vectors."""
        _, p, k = self.quotes[n]
        bits, m = self.masks[n], len(p)
        full, top = (1 << m) - 1, 1 << m - 1
        vp, vn, score = full, 0, m
        for j, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            xv = eq | vn
            xh = ((eq & vp) + vp ^ vp) | eq
            hp = vn | full & ~(xh | vp)
            hn = vp & xh
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp <<= 1
            vp = (hn << 1 | ~(xv | hp)) & full
            vn = hp & xv & full
            if score <= k:
                yield j, score

    def places(self, codes: np.ndarray):
        """(quotes, first diagonals, last diagonals): where in the text a quote may occur, with the diagonals that its alignments may touch."""
        for q, ns, budget, parts, first, count, value, low, high, longest in self.tables:
            slot = self.slots(codes, q)
            c = count[slot]
            at = np.flatnonzero(c)
            c = c[at]
            total = int(c.sum())
            here = np.repeat(first[slot[at]] - np.cumsum(c) + c, c) + np.arange(total)
            key = value[here] + np.repeat(at << low, c)
            key.sort()
            place = key >> low  # of the quote and the diagonal
            who = key >> high
            far = np.arange(total) + (parts - budget - 1)[who]
            good = np.flatnonzero(far < total)
            good = good[place[far[good]] - place[good] <= budget[who[good]]]
            end = np.searchsorted(place, place[good] + budget[who[good]], "right")
            new = np.concatenate([[True], end[1:] != end[:-1]])[: len(good)]  # else all its pieces are those of the one before
            good, end = good[new], end[new]
            keep = end - good > self.WIDEST
            for a, b in ((0, 16), (16, 32), (32, self.WIDEST)):
                for some in np.array_split(x := np.flatnonzero((end - good > a) & (end - good <= b)), len(x) // 4096 + 1):
                    w = who[good[some]]
                    keep[some] = self.chained(key, place, good[some], end[some], b, low, parts[w], budget[w])
            good, end = good[keep], end[keep]
            w = who[good]
            least = parts[w] - budget[w]  # so many pieces are kept, of whichever there are
            diagonal = lambda i: (place[i] & ((1 << high - low) - 1)) - longest
            yield ns[w], diagonal(good + least - 1) - budget[w], diagonal(end - least) + budget[w]

    @staticmethod
    def chained(key, place, first, end, width, low, parts, budget) -> np.ndarray:
        """Whether some of the pieces from first to end, in order, leave room for the budget: between two kept pieces each piece lost and each diagonal passed costs one."""
        at = first + np.arange(width)[:, None]
        none = at >= end
        at = np.minimum(at, len(key) - 1)
        away = int(budget.max() if len(budget) else 0).bit_length()
        kind = np.int16 if low + away <= 14 else np.int64
        both = np.where(none, 1 << low + away, (key[at] & ((1 << low) - 1)) << away | np.minimum(place[at] - place[first], (1 << away) - 1)).astype(kind)
        both.sort(axis=0)
        part = both >> away
        lost = parts - ((part[1:] != part[:-1]) & (part[1:] < parts)).sum(axis=0) - 1
        some = np.flatnonzero(lost <= budget)  # else there are too few different pieces
        out = np.zeros(len(first), dtype=bool)
        part, d, parts, budget = part[:, some], both[:, some] & ((1 << away) - 1), parts[some].astype(kind), budget[some].astype(kind)
        cost, found = part.copy(), np.zeros(len(some), dtype=bool)
        for t in range(width):
            if t:
                gap = part[t] - part[:t]
                x = np.maximum(gap - 1, np.abs(d[t] - d[:t])) + cost[:t]
                x += (gap == 0).astype(kind) << 13  # the same piece
                np.minimum(cost[t], x.min(axis=0), out=cost[t])
            found |= (part[t] < parts) & (cost[t] + (parts - 1) - part[t] <= budget)
        out[some] = found
        return out

    def confirmed(self, codes: np.ndarray, who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a quote occurs within its budget on these diagonals, for many of them; characters count as equal if their last eight bits are.

        The edit matrices have a row for each character of the quote and a column for each diagonal; a cell depends on those with a lesser sum
        of twice its row and its column, so all of one sum are found together. Even and odd columns are kept apart.
        """
        out = np.zeros(len(who), dtype=bool)
        size = np.array([len(p) for _, p, _ in self.quotes])
        budget = np.array([k for _, _, k in self.quotes])
        order = np.argsort(size[who], kind="stable")
        text = (codes & 255).astype(np.uint8)
        for some in (order[i : i + self.SIDE] for i in range(0, len(order), self.SIDE)):
            n, count = who[some], len(some)
            m, k, side = size[n], budget[n], np.arange(count)
            top, wide = int(m.max()), int((end[some] - begin[some]).max() + 1) // 2
            wide = max(wide, 1)
            quote = np.zeros((top + 2 * wide + 2, count), dtype=np.uint8)  # last character first, with room on both sides
            for x, i in enumerate(n):
                p = self.codes(self.quotes[i][1]) & 255
                quote[wide + 1 + top - len(p) : wide + 1 + top, x] = p[::-1]
            at = begin[some] + np.arange(top + 3 * wide + 2)[:, None]
            here = np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)], 255)
            kind, most = (np.uint8, 250) if k.max() < 250 else (np.uint16, 65000)
            even, odd, best = np.zeros((wide + 1, count), kind), np.zeros((wide, count), kind), np.full(count, most, dtype=kind)
            near = np.empty((wide + 1, count), kind)
            for h in range(1, top + wide + 1):
                lo = wide + 1 + top - h  # of the quote's character h - 1, counted from the last one
                for cells, others, text_at in ((even, odd, h - 1), (odd, even, h)):
                    rows = len(cells)
                    differs = (quote[lo : lo + rows] != here[text_at : text_at + rows]).view(np.uint8)
                    cells += differs
                    if cells is even:
                        np.minimum(odd[1:], odd[:-1], out=near[1:wide])
                        near[0], near[wide] = odd[0], odd[-1]
                    else:
                        np.minimum(even[1:], even[:-1], out=near[:wide])
                    part = near[:rows]
                    part += 1
                    np.minimum(cells, part, out=cells)
                    np.minimum(cells, most, out=cells)
                    if h < rows:
                        cells[h:] = 0
                    x = h - m
                    seen = np.flatnonzero((x >= 0) & (x < rows))
                    if len(seen):
                        best[seen] = np.minimum(best[seen], cells[x[seen], seen])
            out[some] = best <= k
        return out

    def all_hits(self, texts: list[str]) -> list[list[tuple[object, int, int, int]]]:
        """(id, start, end, distance) of all quotes in each text: the rows of ``approximate`` over the whole text."""
        texts = [folded(t) for t in texts]
        out: list[list] = [[] for _ in texts]
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) < self.CHUNK:
                size += len(texts[hi]) + 1
                hi += 1
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])])
            codes = self.codes("\0".join(texts[lo:hi]))
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for places in self.places(codes):
                sure = self.confirmed(codes, *places)
                for n, d, e in zip(*(x[sure].tolist() for x in places)):
                    a, b = np.searchsorted(begins, [max(d, 0), e + len(self.quotes[n][1])], "right") - 1
                    for t in range(int(a), min(int(b), hi - lo - 1) + 1):
                        found.setdefault((t, n), []).append((d - int(begins[t]), e - int(begins[t])))
            for (t, n), ds in found.items():
                out[lo + t] += self.hits_near(texts[lo + t], n, ds)
            for t in range(lo, hi):
                out[t] += [h for n in self.whole for h in self.hits_near(texts[t], n, None)]
            lo = hi
        return out

    def hits_near(self, text: str, n: int, diagonals: list[tuple[int, int]] | None):
        """(id, start, end, distance) of a quote in a folded text, with ends that are on diagonals from first to last of a range; anywhere for None."""
        id_, p, k = self.quotes[n]
        m = len(p)
        if diagonals is None:
            all_ = dict(self.ends(n, text))
        else:
            all_, ranges = {}, []
            for a, b in sorted(diagonals):
                if ranges and a <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(b, ranges[-1][1])
                else:
                    ranges.append([a, b])
            for a, b in ranges:
                low = max(a - k, 0)  # an alignment that ends here begins after it
                all_ |= {low + e: d for e, d in self.ends(n, text[low : max(b + m, 0)]) if low + e >= a + m}
        best, last = [], -1
        for end, d in sorted(all_.items()):
            if end != last + 1 or not best:
                best.append((end, d))
            elif d < best[-1][1]:
                best[-1] = (end, d)
            last = end
        for end, d in best:
            if not d:
                yield id_, end - m, end, 0
                continue
            low = max(end - 2 * (m + k) - 4, 0)  # all alignments within the budget, and those they are compared with, begin after it
            start, _, d = approximate_folded(text[low:end], p, k)[-1]
            yield id_, start + low, end, d

    def hits(self, text: str) -> list[tuple[object, int, int, int]]:
        """``all_hits`` of one text."""
        return self.all_hits([text])[0]


def quote_hits(text: Column, quotes: list[tuple[int, str, int]]) -> Column:
    """array<struct<item_id, start, end, distance>>: every hit of quotes, given as (item_id, quote, budget), in the text; empty for a null text."""
    index = Quotes(quotes)

    @F.pandas_udf("array<struct<item_id: bigint, start: int, end: int, distance: int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            hits = (h for lo in range(0, len(texts), 500) for h in index.all_hits(["" if t is None else t for t in texts[lo : lo + 500]]))
            rows = [[] if t is None else [{"item_id": i, "start": s, "end": e, "distance": d} for i, s, e, d in h] for t, h in zip(texts, hits)]
            yield pd.Series(rows)

    return scan(text)


def interleave(x: int, y: int) -> int:
    """Morton code: the bits of x at even, those of y at odd places."""
    out = 0
    for k in range(31):
        out |= (x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1
    return out


def z_ranges(x0: int, y0: int, x1: int, y1: int, bits: int = 16) -> list[tuple[int, int]]:
    """Ranges of Morton codes that cover a rectangle (ends included) and nothing else, by quartering the square."""
    out: list[tuple[int, int]] = []

    def visit(x: int, y: int, size: int) -> None:
        if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
            return
        if x0 <= x and x + size - 1 <= x1 and y0 <= y and y + size - 1 <= y1:
            low = interleave(x, y)
            if out and out[-1][1] + 1 == low:
                out[-1] = (out[-1][0], low + size * size - 1)
            else:
                out.append((low, low + size * size - 1))
            return
        half = size // 2
        for dy in (0, half):
            for dx in (0, half):
                visit(x + dx, y + dy, half)

    visit(0, 0, 1 << bits)
    return out
