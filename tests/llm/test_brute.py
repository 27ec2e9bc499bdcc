"""What SQL can't express: against brute force, an exact round trip, or held-out rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillmill.llm import fingerprints, html_extract, license_scan, line_dedup, ngram_join, packing, quality_bayes, quality_rules, source_mixing, toxicity
from rillmill.llm.linear import train
from rillmill.llm.shared import read, sheltered
from rillmill.llm.sql import license_sql, line_dedup_sql, mix_sql, ngram_join_sql, similar_pairs_sql
from tests.compare import connect, rows_of

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def by_sql(docs, sql: str):
    con = connect(SMALL)
    con.register("fixture", docs.toPandas())
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())


def here(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def held_out(spark, score, column, label):
    """(scores, labels) of the half of the labelled rows that the model hasn't seen."""
    docs, labels = read(spark, LARGE, "documents"), read(spark, LARGE, "labels")
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))
    got = score(docs, labels.where(half == 0)).join(labels.where(half == 1).select("doc_id", F.col(label).alias("_y")), "doc_id").select(column, "_y").toPandas()
    return got[column].to_numpy(), got["_y"].to_numpy()


def auc(p, y) -> float:
    pos, neg = p[y == 1], p[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


@pytest.mark.parametrize(
    ("score", "column", "label", "least"),
    [
        (quality_rules.score_quality, "probability", "quality", 0.98),
        (toxicity.score_toxicity, "probability", "toxic", 0.95),
        (quality_bayes.quality_posteriors, "posterior", "quality", 0.98),
    ],
)
def test_held_out_accuracy(spark, score, column, label, least):
    p, y = held_out(spark, score, column, label)
    assert auc(p, y) >= least


def test_fingerprints_estimate_generalised_jaccard():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.zipf(1.6, 400) % 300]
    texts = [" ".join(base)]
    for change in (20, 80, 160, 300):
        other = list(base)
        for k in rng.choice(len(base), change, replace=False):
            other[k] = f"x{rng.integers(500)}"
        texts.append(" ".join(other))
    sig = fingerprints.signatures(texts, 1024)
    counts = [Counter(t.split()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            words = set(counts[i]) | set(counts[j])
            true = sum(min(counts[i][w], counts[j][w]) for w in words) / sum(max(counts[i][w], counts[j][w]) for w in words)
            assert abs(np.mean(sig[i] == sig[j]) - true) < 0.06


def best_fit(lengths: list[int], window: int) -> Counter:
    """Room left in each window, item by item."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(window - n)
    return Counter(room)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit_decreasing(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = [int(n) for n in rng.integers(1, 90, 300)] + [int(n) for n in rng.integers(1, 8, 100)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)], "doc_id bigint, text string")
    rows = packing.pack(docs, window=64).collect()
    assert sorted((r["doc_id"], r["doc_offset"], r["n_tokens"]) for r in rows) == sorted(
        (i, at, min(64, n - at)) for i, n in enumerate(lengths) for at in range(0, n, 64)
    )
    used = defaultdict(list)
    for r in rows:
        used[r["window_id"]].append((r["window_offset"], r["n_tokens"]))
    for spans in used.values():
        at = 0
        for begin, n in sorted(spans):
            assert begin == at
            at += n
        assert at <= 64
    room = Counter(64 - sum(n for _, n in spans) for k, spans in used.items() if k >= 0)
    assert room == best_fit([n % 64 for n in lengths if n % 64], 64)


def test_bayes_posteriors(spark):
    """Formulas row by row, from the classifier's evidence."""
    docs, labels = sheltered(read(spark, SMALL, "documents")), read(spark, SMALL, "labels")
    model = train(docs, labels, "quality", 4000)
    rows = [tuple(r) for r in quality_bayes.evidence(docs, model, ["doc_id"]).select("doc_id", "_host", "_path", "_p").collect()]
    host, path = defaultdict(list), defaultdict(list)
    for _, h, q, p in rows:
        host[h].append(p)
        path[h, q].append(p)
    n = len(rows)
    mu = sum(p for *_, p in rows) / n
    strength = lambda r, v: min(1e6, max(1.0, r * (1 - r) / max(v, 1e-9) - 1))
    spread = (sum(sum(v) ** 2 / len(v) for v in host.values()) - n * mu * mu - (len(host) - 1) * mu * (1 - mu)) / max(n - sum(len(v) ** 2 for v in host.values()) / n, 1.0)
    hk = strength(mu, spread)
    prior = {k: (sum(host[k[0]]) + hk * mu) / (len(host[k[0]]) + hk) for k in path}
    b = sum(len(v) * (sum(v) / len(v) - prior[k]) ** 2 for k, v in path.items())
    v1 = sum(x * (1 - x) for x in prior.values())
    n2 = sum(len(v) ** 2 / len(host[k[0]]) for k, v in path.items())
    pk = strength(sum(prior.values()) / len(prior), (b - v1) / max(n - n2, 1.0))
    want = []
    for i, h, q, p in rows:
        up = (sum(host[h]) - p + hk * mu) / (len(host[h]) - 1 + hk)
        at = min(1 - 1e-6, max(1e-6, (sum(path[h, q]) - p + pk * up) / (len(path[h, q]) - 1 + pk)))
        odds = np.log(p / (1 - p)) - np.log(model.base / (1 - model.base)) + np.log(at / (1 - at)) if p > 0 else -np.inf
        want.append((i, 1 / (1 + np.exp(-odds))))
    got = sorted(tuple(r) for r in quality_bayes.quality_posteriors(docs, labels).collect())
    for (i, x), (j, y) in zip(got, sorted(want), strict=True):
        assert i == j and abs(x - y) < 2e-5


def test_repeated_line_runs(spark):
    """Long runs, runs within one document, overlapping runs and copies of whole documents."""
    rng = np.random.default_rng(11)
    pool = [f"a line of some words, number {k}" for k in range(30)]
    texts = ["\n".join(pool[k] for k in rng.integers(0, 30, int(rng.integers(1, 40)))) for _ in range(25)]
    run = "\n".join(f"a long passage, part {k}" for k in range(40))
    texts += [run, "head\n" + run + "\ntail", run + "\n" + run, texts[0], "x\ny\nx\ny", "\n" * 70, "\n" * 60]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert here(line_dedup.dedup_lines(docs)) == by_sql(docs, line_dedup_sql(line_dedup.MIN_CHARS, "fixture"))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_pairs_with_a_crowded_passage(spark, monkeypatch, threshold):
    """Many blocks, buckets and meetings of a region, and ties at the threshold: brute force over all pairs."""
    for name, value in (("BLOCK", 5), ("OFTEN", 2), ("BLOCK_DOCS", 7), ("BLOCK_GRAMS", 900), ("BUCKET_CHARS", 2000)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(4000)}"
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(int(rng.integers(20, 90)))) + " " + passage for _ in range(40)]
    near = " ".join(word() for _ in range(120)).split()
    for _ in range(25):
        w = list(near)
        for k in rng.choice(120, 4, replace=False):
            w[k] = word()
        texts.append(" ".join(w))
    for m in (1, 2, 4, 8):  # of n + 2 words shared n n-grams, m of them alone
        texts += [" ".join(f"t{m}x{i}" for i in range(m + 2)), " ".join(f"t{m}x{i}" for i in range(2 * m + 2))]
    texts += [texts[0], passage, passage + " end", "two words", "Two  words", "one", "", " ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).sortWithinPartitions("doc_id")
    assert here(ngram_join.similar_documents(docs, threshold=threshold)) == by_sql(docs, ngram_join_sql(threshold, "fixture"))
    pairs = f"with recursive {similar_pairs_sql(threshold, 'fixture')} select least(x.ids[1], y.ids[1]) as doc_a, greatest(x.ids[1], y.ids[1]) as doc_b, round(j, 6) as jaccard from p join s x on p.u = x.k join s y on p.v = y.k"
    assert here(ngram_join.similar_pairs(docs, threshold=threshold)) == by_sql(docs, pairs)


def test_one_of_each_group_stays(spark):
    docs = read(spark, MIDDLE, "documents")
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each_group(docs).collect()}
    late = {i for i, c, _ in connect(MIDDLE).execute(ngram_join_sql(ngram_join.THRESHOLD)).fetchall() if i != c}
    assert kept == {r["doc_id"] for r in docs.collect()} - late


def test_an_id_with_two_texts(spark):
    text = "a text of some words that two documents share but for its end"
    docs = spark.createDataFrame([(1, text), (2, text + " here"), (2, "another one, which is like nothing else in the table"), (3, "x y z"), (3, "x y z")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in ngram_join.similar_documents(docs).collect()) == [(1, 1, 1), (2, 1, 1)]
    assert sorted(tuple(r) for r in ngram_join.keep_one_of_each_group(docs).collect()) == [(1, text), (2, "another one, which is like nothing else in the table"), (3, "x y z"), (3, "x y z")]


def test_license_notices(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of it. The software is provided \"as is\", without warranty of any kind."
    texts = [notice, "x " * 5000 + notice, notice.split(" of it")[0], "LICENSED under the Apache License, Version 2.0\n" * 3, "the apache version", "gnu general public license; either version 3 of the License, or (at your option) any later version"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert here(license_scan.license_scan(docs)) == by_sql(docs, license_sql(table="fixture"))


MIT = """MIT License

Copyright (c) 2020 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
LINUX = "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."


@pytest.mark.parametrize(
    "text, names",
    [
        (MIT, {"MIT": 2}),  # the heading and the text
        (MIT.split("\n", 4)[4], {"MIT": 1}),
        (MIT.split("\n", 4)[4].replace("software and", "software and " + "many " * 5000), {"MIT": 1}),
        (MIT.split("\n\nTHE")[0].split("\n", 4)[4], {}),
        ("The MIT License (MIT)\r\n\r\nCopyright (c) 2020", {"MIT": 1}),
        ("Unlike the MIT License, this one is long.", {}),
        (GPL, {"GPL-3.0": 1}),
        (GPL.replace("version 3", "version 2"), {"GPL-2.0": 1}),
        (LINUX, {"GPL-2.0": 1}),
        ("   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", {"GPL-3.0": 1}),
        ("// SPDX-License-Identifier: MIT\nint x;", {"MIT": 1}),
        ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0", {"MIT": 1, "Apache-2.0": 1, "GPL-2.0": 1}),
        ("/* SPDX-License-Identifier: LGPL-2.1-or-later */ MIT", {"LGPL": 1}),
        ("SPDX-License-Identifier: MIT-CMU", {}),
    ],
)
def test_unabridged_licence_notices(text, names):
    found = license_scan.Index(license_scan.NOTICES, {}, 1).scan(text.lower())
    assert Counter(name for name, _, _ in found) == names


def test_unabridged_notice_through_spark(spark):
    docs = spark.createDataFrame([(0, "x y " + MIT.split("\n", 4)[4]), (1, "submit permits"), (2, "SPDX-License-Identifier: MIT")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in license_scan.license_scan(docs).collect()) == [(0, "MIT", 1, 2), (2, "MIT", 1, 0)]


def test_mixture(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 30)), str(rng.choice(["en", "de", "xx"])), f"src{rng.integers(25)}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = source_mixing.mix(docs).withColumnsRenamed({"_domain": "domain", "_lang": "lang", "_source": "source", "_epoch": "epoch"})
    assert here(out) == by_sql(docs, mix_sql(table="fixture"))


def test_article_of_a_page():
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><ul>" + "".join(f"<li><a href='/{k}'>menu</a></li>" for k in range(8))
        + "</ul><h1>Nine words make the heading of this short page</h1><p>" + "many words of running text " * 8 + "</p><p>" + "and some more of it &amp; so on " * 7 + "</p><div>Copyright line at the end</div></body></html>"
    )
    [(text, n, kept)] = html_extract.extract([page], html_extract.Tree(html_extract.LABELLED))
    assert (n, kept) == (12, 3)
    assert text.startswith("Nine words") and "menu" not in text and "Copyright" not in text and "& so on" in text


def test_stages_follow_one_another(spark, tmp_path):
    """run() gives what the stages give one by one, and every word of the mixture is placed once."""
    docs = read(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(r["text"].split())
    got = Counter()
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want
