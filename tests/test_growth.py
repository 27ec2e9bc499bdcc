"""Steps whose cost once outgrew their input: the same results as naive versions, and the shape that keeps the cost down."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillmill.functions import text as texts_
from rillmill.functions.pythonic import Quotes
from rillmill.operators import compose, language, recursion
from rillmill.plans import dataflow, graphs, registry
from tests.compare import DATA, assert_same, connect


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_windows_share_a_batch(small_batches):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 2**60 + 1]), rng.choice([None, *range(0, 900, 7)]), i, rng.choice(["a", None, "b"])) for i in range(400)] + [(5, 3, i, "long") for i in range(400, 450)]
    rng.shuffle(rows)
    df = small_batches.createDataFrame(rows, "u bigint, t bigint, i int, k string").repartition(3)
    out = compose.on_window(df, "t", 100, ["i"], lambda a, b, r: {"u": r["u"][0], "a": a, "b": b, "ids": ",".join(map(str, r["i"])), "last": r["k"][-1]}, "u bigint, a bigint, b bigint, ids string, last string", ("u",))
    assert "InPandas" not in plan(out)  # one call of Python for each group
    want = defaultdict(list)
    for u, t, i, k in sorted(rows, key=lambda r: r[2]):
        want[u, None if t is None else t // 100 * 100].append((i, k))
    assert {(r["u"], r["a"]): (r["b"], r["ids"], r["last"]) for r in out.collect()} == {(u, a): (None if a is None else a + 100, ",".join(str(i) for i, _ in v), v[-1][1]) for (u, a), v in want.items()}
    sums = compose.summarize_rows(df, ["k"], ["i"], lambda key, r: {"k": key[0], "n": len(r), "first": r["i"][0]}, "k string, n bigint, first int")
    assert "InPandas" not in plan(sums)
    assert {r["k"]: (r["n"], r["first"]) for r in sums.collect()} == {k: (len(v), min(v)) for k in ("a", "b", None, "long") for v in [[r[2] for r in rows if r[3] == k]]}


def test_many_keys_of_two_sides_share_a_batch(small_batches):
    rng = random.Random(9)
    left = [(rng.choice([None, *range(40), 2**60 + 1]), i) for i in range(120)]
    right = [(rng.choice([None, *range(30, 70), 2**60 + 1]), rng.choice([None, f"v{i}"])) for i in range(120)]
    a, b = small_batches.createDataFrame(left, "k bigint, v int").repartition(3), small_batches.createDataFrame(right, "k bigint, w string")
    out = compose.on_match(a, b, "k", lambda key, x, y: [{"k": key[0], "v": sorted(map(int, x["v"])), "w": sorted(map(str, y["w"]))}] * 2, "k bigint, v array<int>, w array<string>")
    assert "InPandas" not in plan(out)
    vs, ws = defaultdict(list), defaultdict(list)
    for d, rows in ((vs, left), (ws, right)):
        for k, x in rows:
            d[k].append(x)
    want = [(k, sorted(vs[k]), sorted(map(str, ws[k]))) for k in (vs.keys() | ws.keys()) - {None}] + [(None, sorted(vs[None]), []), (None, [], sorted(map(str, ws[None])))]
    assert sorted(map(str, want * 2)) == sorted(str((r["k"], r["v"], r["w"])) for r in out.collect())


def test_model_moves_the_corpus_once(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    model = language.KneserNey(df, "id", F.split("t", " "), order=3)
    grams = Counter(tuple(w[i : i + 3]) for t in texts for w in [t.split(" ")] for i in range(len(w) - 2))
    pairs = Counter(g[1:] for g in grams)
    assert {(r["t1"], r["t2"], r["t3"]): r["_c"] for r in model.counts(3).collect()} == grams
    assert {(r["t1"], r["t2"]): r["_c"] for r in model.counts(2).collect()} == pairs
    assert {r["t1"]: r["_c"] for r in model.counts(1).collect()} == Counter(g[1] for g in pairs)
    assert "_t," not in plan(language.grams(df, "id", F.split("t", " "), 3)).split("Generate")[0]
    assert plan(model.counts(2)).count("Exchange hashpartitioning") == 1
    two = language._distinct([(np.array([0, 1, 0, 0]), 1 << 40), (np.array([5, 5, 5, 5]), 1 << 40), (np.array([1, 1, 2, 1]), 1 << 40)])
    assert [x.tolist() for x in two] == [[0, 2, 1], [2, 1, 1]]


def test_lineage_figures_store_no_pairs(small_batches, monkeypatch):
    monkeypatch.setattr(recursion, "cut", None)  # pairs would be written by it
    monkeypatch.setattr(recursion, "WALKED", 5)
    rng = random.Random(11)
    edges = [(i, rng.randrange(-5, i)) for i in range(60) for _ in range(rng.randrange(3))] + [(7, 2**61), (2**61, 3), (None, 3), (4, None)]
    targets = [*range(-2, 61), 5, 5, 2**61, None]
    df = small_batches.createDataFrame(edges, "id bigint, source bigint").repartition(3)
    got = recursion.lineage_figures(df, small_batches.createDataFrame([(t,) for t in targets], "id bigint"))
    want = {(None, 1, None, None)}
    for t in set(targets) - {None}:
        seen, front = {t}, {t}
        while front:
            front = {s for i, s in edges if i in front and s is not None} - seen
            seen |= front
        want.add((t, len(seen), min(seen), sum(seen)))
    assert {tuple(r) for r in got.collect()} == want
    none = recursion.lineage_figures(df.where("false"), small_batches.range(3))
    assert {tuple(r) for r in none.collect()} == {(i, 1, i, i) for i in range(3)}


@pytest.mark.parametrize("name", ["span_pairing", "span_stats", "trace_snapshot"])
def test_more_rows_have_more_partitions(spark, monkeypatch, name):
    monkeypatch.setattr(graphs, "SHARE", 300)
    monkeypatch.setattr(dataflow, "SHARE", 300)
    assert "REPARTITION_BY_NUM" in plan(registry.QUERIES[name](spark, DATA))
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_quotes_are_sought_singly_only_where_they_are(monkeypatch):
    con = connect()
    quotes = [(i, t, max(4, len(t) // 5)) for i, t in con.execute("select item_id, text from benchmark where text is not null").fetchall()]
    texts = [t for (t,) in con.execute("select text from documents where text is not null order by doc_id").fetchall()]
    rng = random.Random(4)
    for i, t, k in quotes:  # near copies, with and without prose around them
        x = list(t)
        for _ in range(rng.choice((0, 2, k // 2, k, k + 2))):
            x[rng.randrange(len(x))] = rng.choice(("", "q", " z"))
        texts.append(rng.choice(("", texts[i][:200])) + "".join(x) + rng.choice(("", texts[i][-200:])))
    index, sought, ends = Quotes(quotes), set(), Quotes.ends
    monkeypatch.setattr(Quotes, "ends", lambda self, n, text: sought.add((n, text)) or ends(self, n, text))
    each = [sorted(index.hits(t)) for t in texts]
    pairs = sum(len({h[0] for h in hits}) for hits in each)
    assert pairs > 20
    assert len(sought) <= 2 * pairs  # it was every place that pieces made likely
    for size in (1, 3000, 1 << 22):
        monkeypatch.setattr(Quotes, "CHUNK", size)
        assert [sorted(h) for h in index.all_hits(texts)] == each


def test_words_in_arrow_are_those_of_the_pattern():
    rng = random.Random(6)
    texts = ["", "'", "a'b'c'd5'e", "x'", "'y", "a''b", "é'a ü", "rock'n'roll", *("".join(rng.choice("ab1'' é") for _ in range(rng.randrange(12))) for _ in range(3000)), "z'"]
    want = [re.findall("[a-z0-9]+(?:'[a-z]+)?", t) for t in texts]
    assert language.word_lists(pa.array(texts)).to_pylist() == want
    assert language.word_lists(pa.array(texts).slice(3, 900)).to_pylist() == want[3:903]
    assert language.word_lists(pa.array(["", ""])).to_pylist() == [[], []]


def test_pairs_are_moved_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 60)
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, " ".join(rng.choice("aAbcd'e") for _ in range(rng.randrange(9)))])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    want = Counter((k, *w[i : i + 2]) for k, t in rows if k and t for w in [re.findall("[a-z0-9]+(?:'[a-z]+)?", t.lower())] for i in range(len(w) - 1))
    left, right, whole = (Counter() for _ in range(3))
    for (k, a, b), n in want.items():
        left[k, a, None] += n
        right[k, None, b] += n
        whole[k, None, None] += n
    all_ = want | left | right | whole
    known = df.where("k is not null")
    assert {(r["k"], r["t1"], r["t2"]): r["_c"] for r in language.summed_pairs(known, ["k"], F.col("t"), 40, 7).collect()} == {g: n for g, n in all_.items() if n >= 40 or g in whole}
    moved = plan(language.summed_pairs(known, ["k"], F.col("t"), 5, 7))
    assert moved.count("Exchange") == 2 and "Generate" not in moved and "regexp" not in moved
    assert {tuple(r)[:4] for r in language.collocations(df, ["k"], F.col("t"), 40).collect()} == {(*g, n) for g, n in want.items() if n >= 40}


def test_style_finds_the_tokens_of_a_text_once(spark):
    texts = [None, "", " \n\n ", "Never 20 x\u212a of it, never I'd say! Kind of.\n \nMy my. You\u0130s Http https://x.y `a b`", "no\u212a No's maybe; It isn't.", "One Two's I Three\n\n\nfour?! 1.5, a2 3,x 4._ 55"]
    df = texts_.style_features(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text")
    assert plan(df).count("transform(") == 1  # tokens of paragraphs aren't sought again
    assert plan(df).count("regexp_extract_all(lower(_x") == 1 and "CASE WHEN (Contains(_x" in plan(df)  # nor are those in lower case, but for rare letters
    rows = {r["id"]: r for r in df.collect()}
    for i, t in enumerate(texts):
        t, r = t or "", rows[i]
        raw = re.findall(texts_.TOKEN, t)
        # Java's lower case of the dotted capital I is an i and a mark
        toks = re.findall("[a-z0-9]+(?:'[a-z]+)?", t.lower())
        parts = [[len(re.findall(texts_.TOKEN, p)) for p in re.split(e, t) if re.search(r"\S", p)] for e in (texts_.SENTENCE_END, texts_.PARAGRAPH_END)]
        assert (r["n_tokens"], r["n_sentences"], r["n_paragraphs"]) == (len(toks), *map(len, parts))
        assert (r["sentence_mean"], r["paragraph_mean"]) == pytest.approx([sum(p) / len(p) if p else 0 for p in parts])
        assert r["word_mean"] == pytest.approx(sum(map(len, toks)) / len(toks) if toks else 0)
        for k, (words, phrases) in texts_.LEXICONS.items():
            n = sum(w in words for w in toks) + sum(t.lower().count(p) for p in phrases)
            assert r[f"{k}_rate"] == pytest.approx(100 * n / len(toks) if toks else 0)
        names = sum(a[0].isupper() and a != "I" and b[0].isupper() and b != "I" for a, b in zip(raw, raw[1:]))
        assert r["name_rate"] == pytest.approx(100 * names / len(toks) if toks else 0)
        assert r["number_rate"] == pytest.approx(100 * len(re.findall(r"\b\d[\d.,]*\b", t, re.A)) / len(toks) if toks else 0)
        assert r["link_rate"] == pytest.approx(100 * len(re.findall(r"https?://\S+", t)) / len(toks) if toks else 0)
