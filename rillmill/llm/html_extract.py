"""HTML extraction from flat text blocks.

A page becomes a sequence of text blocks, cut at block-level tags. A decision
tree tells content from boilerplate by six numbers: word count and link
density of the block and of its two neighbours. The tree is grown here from
LABELLED, a small table of hand-labelled blocks.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmill.llm.shared import sheltered

FEATURES = ("previous_words", "previous_links", "words", "links", "next_words", "next_links")
# FEATURES, then 1 for content
LABELLED = np.array([
    # menus: linked words among linked words
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (2, 1, 1, 1, 2, 1, 0), (1, 1, 2, 1, 1, 1, 0), (1, 1, 1, 1, 9, 0, 0), (3, 1, 4, 1, 2, 1, 0), (2, 1, 6, 1, 14, 0, 0), (0, 0, 5, 1, 40, 0, 0),
    (40, 0, 2, 1, 1, 1, 0), (85, .02, 3, 1, 3, 1, 0), (12, 0, 8, .9, 7, .8, 0), (5, .8, 12, .75, 9, .9, 0), (120, 0, 15, .6, 6, 1, 0), (4, 1, 22, .7, 18, .6, 0), (6, 1, 30, .55, 12, 1, 0), (10, .5, 9, .6, 0, 0, 0),
    (1, 1, 1, 1, 12, 0, 0), (1, 1, 1, 1, 45, 0, 0), (1, 1, 2, 1, 80, 0, 0), (2, 1, 1, 1, 7, 0, 0), (30, 0, 1, 1, 1, 1, 0), (60, 0, 2, 1, 45, 0, 0), (1, 1, 3, 1, 150, .02, 0),
    # advertisements and other lines between a menu and the text
    (1, 1, 7, 0, 10, 0, 0), (1, 1, 8, 0, 12, 0, 0), (1, 1, 14, 0, 9, 0, 0), (2, 1, 5, 0, 60, 0, 0), (1, 1, 10, 0, 6, 0, 0), (3, 1, 12, 0, 18, 0, 0), (1, 1, 3, 0, 11, 0, 0), (2, 1, 18, .1, 14, 0, 0), (1, 1, 16, 0, 22, 0, 0),
    # footers: nothing follows
    (60, 0, 9, 0, 0, 0, 0), (25, 0, 12, 0, 0, 0, 0), (140, .01, 6, .3, 0, 0, 0), (8, 0, 11, 0, 0, 0, 0), (3, 0, 14, 0, 0, 0, 0), (35, 0, 18, .1, 0, 0, 0), (12, 0, 4, 0, 0, 0, 0), (80, 0, 22, .2, 0, 0, 0), (45, 0, 16, 0, 0, 0, 0),
    # comments, captions and buttons among links
    (2, 1, 3, 0, 2, 1, 0), (1, 1, 2, 0, 1, 1, 0), (6, .8, 4, .5, 5, 1, 0), (0, 0, 2, 0, 1, 1, 0), (0, 0, 3, 0, 4, 1, 0), (3, .6, 1, 0, 4, .7, 0),
    # headings
    (8, 0, 10, 0, 12, 0, 1), (9, 0, 6, 0, 75, 0, 1), (14, 0, 11, 0, 10, 0, 1), (7, 0, 3, 0, 30, .05, 1), (40, 0, 4, 0, 55, 0, 1), (95, .03, 7, 0, 120, 0, 1), (6, 0, 12, 0, 9, 0, 1), (0, 0, 9, 0, 48, 0, 1), (0, 0, 12, 0, 90, .02, 1),
    (1, 1, 9, 0, 40, 0, 1), (2, 1, 7, 0, 85, 0, 1), (1, 1, 11, 0, 120, .02, 1), (3, 1, 8, 0, 50, .05, 1),
    # paragraphs
    (10, 0, 60, 0, 45, 0, 1), (12, 0, 25, 0, 80, .02, 1), (55, 0, 14, 0, 62, 0, 1), (30, 0, 8, 0, 41, 0, 1), (120, .02, 200, .03, 90, 0, 1), (75, 0, 40, .1, 12, 0, 1), (44, 0, 2, 0, 33, 0, 1), (18, 0, 5, 0, 9, 0, 1),
    (65, 0, 3, 0, 12, 0, 1), (20, 0, 1, 0, 15, 0, 1), (11, 0, 34, .2, 50, .1, 1), (38, .1, 28, .3, 44, 0, 1), (4, 0, 90, 0, 11, 0, 1), (2, 0, 6, 0, 70, 0, 1), (9, 0, 9, 0, 12, 0, 1), (70, 0, 35, .02, 8, .2, 1),
    (1, 1, 85, .02, 60, 0, 1), (2, 1, 55, 0, 40, 0, 1), (1, 1, 120, .05, 9, 0, 1), (90, 0, 70, 0, 0, 0, 1), (50, 0, 130, .01, 0, 0, 1), (30, 0, 60, .05, 3, 1, 1), (0, 0, 150, 0, 0, 0, 1), (0, 0, 45, .02, 0, 0, 1), (0, 0, 70, 0, 12, 0, 1),
    (25, .05, 50, .1, 2, 1, 1), (60, 0, 30, 0, 1, 1, 1),
    # short lines in running text
    (45, 0, 2, 0, 7, 0, 1), (30, 0, 9, 0, 3, 0, 1), (8, 0, 5, 0, 2, 0, 1), (3, 0, 8, 0, 6, 0, 1), (15, 0, 1, 0, 1, 0, 1), (60, 0, 12, 0, 5, 0, 1), (22, 0, 16, 0, 8, 0, 1), (11, 0, 12, 0, 4, 0, 1),
    (80, .02, 20, 0, 6, 0, 1), (5, 0, 3, 0, 5, 0, 1), (2, 0, 4, 0, 3, 0, 1), (1, 0, 6, 0, 8, 0, 1), (18, 0, 20, .05, 2, 0, 1), (7, 0, 1, 0, 3, 0, 1),
])

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe label legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<raw>script|style|title|noscript|template|textarea|svg|object)\b(?:[^>]*/>|.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9]*)(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, words, linked words) of each text block that has a word; entities are decoded and white space is folded to single blanks."""
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if in_link:
                linked += len(t.split())

    def close() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words))))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            text(m["cdata"])
        name = (m["name"] or "").lower()
        if name == "a":
            in_link = not m["close"]
        elif name in _BLOCK:
            close()
            in_link = False
        elif name == "br":
            parts.append("\n")
    text(page[at:])
    close()
    return out


def features(sizes: np.ndarray, linked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """FEATURES of blocks; those of page i are bounds[i]:bounds[i + 1]. Beyond the ends of a page there are no words and no links."""
    density = linked / np.maximum(sizes, 1)
    out = np.zeros((len(sizes), 6))
    out[:, 2], out[:, 3] = sizes, density
    if len(sizes):
        page = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        same = page[1:] == page[:-1]
        out[1:, 0], out[1:, 1] = sizes[:-1] * same, density[:-1] * same
        out[:-1, 4], out[:-1, 5] = sizes[1:] * same, density[1:] * same
    return out


class Tree:
    """Binary decision tree by Gini impurity; of equal splits the first feature and the lowest cut are taken."""

    def __init__(self, rows: np.ndarray, depth: int = 6, least: int = 2):
        y = rows[:, -1]
        self.value = float(y.mean() >= 0.5)
        self.feature, self.cut = -1, 0.0
        if depth == 0 or len(rows) < 2 * least or y.min() == y.max():
            return
        best = len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9
        for f in range(rows.shape[1] - 1):
            known = np.unique(rows[:, f])
            for cut in (known[1:] + known[:-1]) / 2:
                low = rows[:, f] <= cut
                if min(low.sum(), (~low).sum()) < least:
                    continue
                impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if impurity < best - 1e-12:
                    best, self.feature, self.cut = impurity, f, float(cut)
        if self.feature >= 0:
            low = rows[:, self.feature] <= self.cut
            self.low, self.high = Tree(rows[low], depth - 1, least), Tree(rows[~low], depth - 1, least)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value > 0)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low(x[low]), self.high(x[~low])
        return out


def extract(pages: list, tree: Tree) -> list[tuple[str, int, int]]:
    """(text, blocks, content blocks) of each page."""
    found = [blocks(p) if p else [] for p in pages]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    flat = [b for f in found for b in f]
    keep = tree(features(np.array([b[1] for b in flat], dtype=float), np.array([b[2] for b in flat], dtype=float), bounds))
    out = []
    for i, f in enumerate(found):
        kept = [b[0] for b, k in zip(f, keep[bounds[i] : bounds[i + 1]]) if k]
        out.append(("\n".join(kept), len(f), len(kept)))
    return out


def extract_html(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks, n_content) for every row of pages; text has one line for each content block.

    A null or empty page, and one without text, has an empty text and no
    blocks. Markup that isn't closed ends with the page; a tag with a stray quote ends at its first ``>``. Pages of any
    length are read whole, in time that grows with their length. Null ids are
    carried along, rows that repeat are extracted each, an empty table gives an empty result. Of
    equal splits the tree takes the first feature and the lowest cut, so ties have one result.
    Columns beside page_id and html are not read, whatever their names.
    """
    tree = Tree(LABELLED)

    def run(batches):
        for b in batches:
            texts, n, kept = [], [], []
            for s in range(0, b.num_rows, 256):
                for t, k, c in extract(b.column(1).slice(s, 256).to_pylist(), tree):
                    texts.append(t)
                    n.append(k)
                    kept.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "n_blocks", "n_content"])

    return sheltered(pages, ("page_id", "html")).select(F.col("page_id").cast("bigint"), "html").mapInArrow(run, "page_id bigint, text string, n_blocks int, n_content int")
