"""Parts of op2, op3, op5 and op7 against naive versions of the same definition."""

import html
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmill.llm import html_extract, line_dedup, linear, quality_bayes, quality_rules, toxicity
from rillmill.llm.textnum import word_hash

RAW = ("script", "style", "title", "noscript", "template", "textarea", "svg", "object")


def slow_blocks(page: str) -> list[tuple[str, int, int]]:
    """Character by character."""
    out, parts, linked, in_link = [], [], 0, False
    low, i, n, begin = page.lower(), 0, len(page), 0

    def to(what: str, at: int, after: bool = True) -> int:
        k = low.find(what, at)
        return n if k < 0 else k + len(what) * after

    def text(raw: str) -> None:
        nonlocal linked
        parts.append(html.unescape(raw))
        linked += len(html.unescape(raw).split()) * in_link

    def close() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words))))
        parts.clear()
        linked = 0

    while i < n:
        if page[i] != "<":
            i += 1
            continue
        name, end, cdata = "", None, ""
        raw = next((r for r in RAW if low.startswith(r, i + 1) and not (low[i + 1 + len(r) : i + 2 + len(r)].isalnum() or low[i + 1 + len(r) : i + 2 + len(r)] == "_")), None)
        if low.startswith("<!--", i):
            end = to("-->", i + 4)
        elif low.startswith("<![cdata[", i):
            end = to("]]>", i + 9)
            cdata = page[i + 9 : to("]]>", i + 9, False)]
        elif raw:
            j = low.find(">", i + 1 + len(raw))
            if j > i + 1 + len(raw) and low[j - 1] == "/":
                end = j + 1
            else:
                m = re.compile(rf"</{raw}\s*>").search(low, i + 1 + len(raw))
                end = m.end() if m else n
        else:
            at = i + 1 + low.startswith("/", i + 1)
            j = at
            while j < n and page[j].isascii() and page[j].isalnum() and (j > at or page[j].isalpha()):
                j += 1
            if j > at:
                name, k, quote = low[at:j], j, ""
                while k < n and (quote or page[k] != ">"):
                    if not quote and page[k] in "\"'":
                        quote = page[k]
                    elif page[k] == quote:
                        quote = ""
                    k += 1
                end = k + 1 if k < n else to(">", j)
            elif page[i + 1 : i + 2] in ("!", "?", "/"):
                end = to(">", i + 2)
        if end is None:
            i += 1
            continue
        text(page[begin:i])
        if cdata:
            text(cdata)
        if name == "a":
            in_link = page[i + 1] != "/"
        elif name in html_extract._BLOCK:
            close()
            in_link = False
        elif name == "br":
            parts.append("\n")
        i = begin = end
    text(page[begin:])
    close()
    return out


SOUP = ["<p>", "</p>", "<a href='x>y'>", "</a>", '<a title="q">', "<a class=b title=\"broken>", "<br/>", "<div", "<DIV class='a'>", "</div >", "<script>", "</script >", "<script src=x/>", "<style", "<!--", "-->", "<!doctype html>", "<![CDATA[", "]]>",
        "<", ">", "'", '"', "&amp;", "&lt;p&gt;", "&", "word", "two words ", "\n", " ", "é", "<li>item</li>", "<svg", "</svg>", "<?php", "?>", "</", "<b>bold</b>", "<titles>", "<td>1"]


@pytest.mark.parametrize("seed", range(40))
def test_blocks_of_dirty_markup(seed):
    rng = np.random.default_rng(seed)
    for _ in range(50):
        page = "".join(SOUP[k] for k in rng.integers(0, len(SOUP), int(rng.integers(1, 40))))
        assert html_extract.blocks(page) == slow_blocks(page), page


@pytest.mark.parametrize("page", ['<a class=nav-item data-x=12345 data-y=67890 title="broken>menu</a>' * 3, "<b '\">" * 200_000, "<script " * 120_000, "<!-- " * 200_000, '<p title="' * 100_000, "word <p> " * 110_000, "<a b='c' " * 120_000])
def test_dirty_and_large_pages_end(page):
    began = time.time()
    html_extract.blocks(page)
    assert time.time() - began < 5


def test_stray_quote_ends_at_the_first_bracket():
    assert html_extract.blocks('<p>one <a class=nav title="broken>menu</a> two</p><p>cut <b') == [("one menu two", 3, 1), ("cut", 1, 0)]


def naive_split(rows: np.ndarray, least: int) -> tuple[int, float] | None:
    gini = lambda y: len(y) * 2 * np.mean(y) * (1 - np.mean(y)) if len(y) else 0.0
    best = None
    for f in range(rows.shape[1] - 1):
        for low, high in zip(sorted(set(rows[:, f])), sorted(set(rows[:, f]))[1:]):
            cut = (low + high) / 2
            a, b = rows[rows[:, f] <= cut, -1], rows[rows[:, f] > cut, -1]
            if min(len(a), len(b)) >= least and (best is None or gini(a) + gini(b) < best[0] - 1e-12):
                best = gini(a) + gini(b), f, cut
    return best and best[1:]


@pytest.mark.parametrize("seed", range(5))
def test_first_split_of_a_tree(seed):
    rng = np.random.default_rng(seed)
    rows = np.concatenate([rng.integers(0, 6, (60, 6)), rng.integers(0, 2, (60, 1))], axis=1).astype(float)
    tree = html_extract.Tree(rows)
    assert (tree.feature, tree.cut) == naive_split(rows, 2)
    assert (html_extract.Tree(rows[:, [0, -1]] * 0 + [0, 1])(rows[:, :1])).all()  # one class only: no split


def test_extraction_is_the_tree_on_each_block(spark):
    rng = np.random.default_rng(3)
    pages = ["".join(SOUP[k] for k in rng.integers(0, len(SOUP), 60)) for _ in range(30)] + [None, "", "<p>x"]
    tree, want = html_extract.Tree(html_extract.LABELLED), []
    for i, page in enumerate(pages):
        found = slow_blocks(page or "")
        side = lambda k: (found[k][1], found[k][2] / found[k][1]) if 0 <= k < len(found) else (0, 0)  # noqa: B023, E731
        kept = [b[0] for k, b in enumerate(found) if tree(np.array([[*side(k - 1), *side(k), *side(k + 1)]], dtype=float))[0]]
        want.append((i, "\n".join(kept), len(found), len(kept)))
    got = html_extract.extract_html(spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string"))
    assert sorted(tuple(r) for r in got.collect()) == want


def naive_score(weights: np.ndarray, bias: float, text: str) -> float:
    """A dictionary of means, one n-gram after the other."""
    text = (text or "").lower()
    words = text.split()
    total = bias
    hashes = [word_hash(w) for w in words]
    families = [[h >> 48 for h in hashes], [0 if a == b else ((a * 3 + b) * 0x9FB21C651E98DF25 & (1 << 64) - 1) >> 48 for a, b in zip(hashes, hashes[1:])]]
    for n in (3, 5):
        grams = []
        for i in range(len(text) - n + 1):
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for k in range(n):
                h = (h ^ ord(text[i + k])) * (0x85EBCA6B + 2 * 0x1234567 * k) & 0xFFFFFFFF
                h ^= h >> 15
            grams.append(h >> 16)
        families.append(grams)
    for k, buckets in enumerate(families):
        if buckets:
            total += sum(float(weights[k * (1 << 16) + b]) for b in buckets) / len(buckets)
    return total


TEXTS = ["", None, "  ", "a", "one one one one", "The quick brown fox, and the lazy dog!", "Ünïcödé wörds ärë fine — 日本語 too", "x y\tz\nx y", "word " * 300, "ab" * 400]


def test_scores_of_the_quality_model(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=linear.SIZE).astype(np.float32)
    assert np.allclose(linear.score(weights, 0.25, TEXTS), [naive_score(weights, 0.25, t) for t in TEXTS], atol=1e-6)
    doc, idx, val = linear.sparse(TEXTS)
    assert np.allclose(np.bincount(doc, weights[idx] * val, minlength=len(TEXTS)) + 0.25, [naive_score(weights, 0.25, t) for t in TEXTS], atol=1e-6)


def test_quality_query_against_scores_one_by_one(spark):
    rows = [(i, f"good text number {i} with reason", 1) for i in range(30)] + [(100 + i, f"junk spam {i} junk", 0) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, " "), (502, "reason")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    model = linear.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    want = []
    for r in docs.collect():
        blank = not (r["text"] or "").strip()
        p = 0.0 if blank else 1 / (1 + math.exp(-(model.a * naive_score(model.weights, model.bias, r["text"]) + model.b)))
        want.append((r["doc_id"], p))
    got = {r["doc_id"]: r for r in quality_rules.score_quality(docs, labels).collect()}
    for i, p in want:
        assert abs(got[i]["probability"] - p) < 1e-5
        assert got[i]["rule"] == ("prefer" if got[i]["probability"] >= 0.9 else "keep" if got[i]["probability"] >= 0.5 else "reject")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).collect()}
    assert kept == {i for i, p in want if p >= 0.5} and kept >= set(range(30)) and not kept & set(range(100, 130))


def test_few_labels_give_the_base_rate(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0, i % 3 == 0) for i in range(linear.LEAST_ROWS - 1)], "doc_id bigint, quality boolean, toxic boolean").select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("quality", "toxic")))
    assert {r["probability"] for r in quality_rules.score_quality(docs, labels).collect()} == {round(4 / 11, 6)}
    assert len({r["posterior"] for r in quality_bayes.quality_posteriors(docs, labels).collect()}) == 1


def test_platt_is_the_best_fit():
    rng = np.random.default_rng(4)
    z = rng.normal(size=300) * 2
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.7 * z - 0.4)))).astype(float)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda a, b: -np.mean(t * np.log(linear.sigmoid(a * z + b)) + (1 - t) * np.log(1 - linear.sigmoid(a * z + b)))
    a, b = linear.platt(z, y)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-7 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_isotonic_is_the_min_max_formula():
    rng = np.random.default_rng(6)
    z = rng.normal(size=80).round(1)  # with ties
    y = (rng.random(80) < 1 / (1 + np.exp(-z))).astype(float)
    order = np.argsort(z, kind="stable")
    v = y[order]
    want = [max(min(v[a : b + 1].mean() for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    at, steps = toxicity.isotonic(z, y)
    assert (np.diff(steps) > 0).all() and (np.diff(at) >= 0).all()
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(steps, 9))


def naive_dense(text: str, words: set, stems: set) -> list[float]:
    """FEATURES of an ASCII text, one word after the other."""
    tokens = re.findall(r"[a-z0-9]+", text.lower())
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)
    plain = [t in toxicity.INSULTS for t in tokens]
    learned = [t in words for t in tokens]
    stem = [t[: toxicity.STEM] in stems for t in tokens]
    second = [t in toxicity.SECOND_PERSON for t in tokens]
    hit = [a or b for a, b in zip(plain, learned)]
    leet = str.maketrans("013457@$!", "oieastasi")
    spelled = re.findall(r"[a-z0-9]+", text.lower().translate(leet))
    disguised = sum(t in toxicity.INSULTS or t in words for t in spelled)
    near = max([1 / (1 + abs(i - j)) for i, a in enumerate(second) if a for j, (b, c) in enumerate(zip(hit, stem)) if b or c], default=0.0)
    n, c = len(tokens), len(text)
    inner = sum(text[i].isdigit() or text[i] in "*_-." for i in range(1, c - 1) if text[i - 1].isalpha() and text[i + 1].isalpha())
    stretched = sum(text[i].isalpha() and text[i] == text[i - 1] == text[i - 2] for i in range(2, c))
    return [
        math.log1p(n), 100 * sum(plain) / n, 100 * sum(learned) / n, 100 * sum(stem) / n, math.log1p(sum(hit)), 100 * sum(second) / n, near, sum(x.isupper() for x in text) / c,
        100 * sum(x in "!?" for x in text) / c, 100 * sum(not x.isalnum() and not x.isspace() for x in text) / c, 100 * max(disguised - sum(hit), 0) / n, 100 * inner / n, 100 * stretched / n,
    ]


def test_features_of_toxicity():
    texts = ["", "!!!", "You are an IDIOT!!", "what an id1ot you are, st*pid m0ron", "soooo nice", "your blorping blorps are good; you scum", "plain words of a plain text " * 30, "u"]
    words, stems = {"blorps"}, {"blorpi"}
    table = lambda xs: np.sort(np.array([word_hash(x) for x in xs], dtype=np.uint64))
    assert np.allclose(toxicity.dense(texts, table(words), table(stems)), [naive_dense(t, words, stems) for t in texts])


def test_learned_lexicon():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 12)) for _ in range(200)]
    y = (rng.random(200) < 0.3).astype(float)
    texts = [t + " badword" * int(v) + " badly" * int(v and i % 2) for i, (t, v) in enumerate(zip(texts, y))]
    rows = np.arange(200) % 3 != 0
    for got, cut in zip(toxicity.learn_lexicon(toxicity.vocabulary(texts), y, rows), (99, toxicity.STEM)):
        pos, neg, want = sum(y[rows]), sum(1 - y[rows]), set()
        held = [{w[:cut] for w in t.split()} for t in texts]
        for w in set.union(*held):
            toxic = sum(w in h for h, v, r in zip(held, y, rows) if r and v)
            other = sum(w in h for h, v, r in zip(held, y, rows) if r and not v)
            if toxic >= toxicity.LEAST_TOXIC and toxic / pos > toxicity.LEAST_ODDS * (other + 0.5) / neg:
                want.add(word_hash(w))
        assert set(got.tolist()) == want and want


def test_first_split_of_a_boosted_tree():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 5, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(float)
    model = toxicity.Trees(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-model.base))
    best = None
    for f in range(3):
        for k, cut in enumerate(model.cuts[f]):
            low = x[:, f] <= cut
            part = lambda m: (y - p)[m].sum() ** 2 / (m.sum() * p * (1 - p) + 1)  # noqa: B023, E731
            gain = part(low) + part(~low)
            if min(low.sum(), (~low).sum()) * p * (1 - p) >= 1 and (best is None or gain > best[0] + 1e-9):
                best = gain, f, k, low
    _, f, k, low = best
    feat, cut, value = model.trees[0]
    assert (feat[0], cut[0]) == (f, k)
    want = [toxicity.RATE * (y - p)[m].sum() / (m.sum() * p * (1 - p) + 1) for m in (low, ~low)]
    assert np.allclose(value, want)
    assert np.allclose(model.log_odds(x), model.base + np.where(low, want[0], want[1]))


def test_ranks_of_a_line_that_most_documents_have(spark):
    """A blank line with many successors: ranks keep the order of (rank, next rank)."""
    rng = np.random.default_rng(14)
    rows = [(0, int(v)) for v in rng.integers(0, 5000, 3000)] + [(9000, int(v)) for v in rng.integers(0, 50, 100)]
    got = line_dedup.next_ranks(spark.createDataFrame(rows, "_r bigint, _next bigint"), 6).collect()
    want = {p: p[0] + sum(q[0] == p[0] and q[1] < p[1] for q in rows) for p in set(rows) if rows.count(p) > 1}
    assert {(r["_r"], r["_next"]): r["_rank"] for r in got} == want
