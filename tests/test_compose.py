"""Composition, sinks, shapes of flows, subjects, codes and models against naive versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillmill.functions import subjects, text, zorder
from rillmill.operators import aggregates, compose, language, recursion, topology
from rillmill.sources import keyed, sinks
from rillmill.streaming.windows import attempt


def test_pacing_is_a_token_bucket(spark):
    rng = random.Random(4)
    rows = [(u, i, rng.randrange(400)) for u in ("a", "b", None) for i in range(60)]
    got = {(r["u"], r["i"]): r["released"] for r in compose.paced(spark.createDataFrame(rows, "u string, i int, t bigint"), "u", "t", "i", 0.25, 3).collect()}
    for u in ("a", "b", None):
        tokens, at = 3.0, 0.0
        for i, t in sorted(((i, t) for k, i, t in rows if k == u), key=lambda x: (x[1], x[0])):
            now = max(at, t)
            tokens, at = min(3.0, tokens + (now - at) * 0.25), now
            if tokens < 1 - 1e-9:
                at += (1 - tokens) / 0.25
                tokens = 1.0
            tokens -= 1
            assert abs(got[u, i] - at) < 1e-6


def test_outputs_are_listed_under_every_input(spark):
    inputs = spark.createDataFrame([(0,), (1,), (2,)], "i bigint")
    outputs = spark.createDataFrame([([0], "a"), ([0], "b"), ([0, 2], "merged"), ([2, 2], "twice")], "sources array<bigint>, v string")
    got = {r["i"]: r["outputs"] for r in compose.outputs_by_input(inputs, outputs, "i", "sources", "v").collect()}
    assert got == {0: ["a", "b", "merged"], 1: [], 2: ["merged", "twice"]}


def test_cache_is_asked_first_and_no_opinion_is_kept(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("?",), (None,)], "t string")
    cache = df.where("t = 'x'").select(F.sha2("t", 256).alias("key"), F.lit(7.0).alias("score"))
    out, fresh = compose.with_cache(df, "t", cache, lambda t: None if t == "?" else 1.0)
    assert Counter((r["t"], r["score"]) for r in out.collect()) == Counter({("x", 7.0): 1, ("y", 1.0): 2, ("?", None): 1, (None, None): 1})
    assert [r["score"] for r in fresh.collect()] == [1.0]


def test_fan_in_keeps_all_arrivals(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "p int, v int")
    got = {r["p"]: r["arrived"] for r in compose.fan_in(compose.fan_out(df, "p", {"v": F.col("v"), "w": -F.col("v")}), "p").collect()}
    assert got == {1: {"v": [3, 5], "w": [-5, -3]}, 2: {"v": [4], "w": [-4]}}


def test_trace_store_keeps_a_payload_once(spark, tmp_path):
    schema = "run_id string, msg_id string, step string, kind string, t bigint, seq int, payload string"
    one = [("r1", "m1", "inc", "recv", 1, 1, "5"), ("r1", "m1", "inc", "success", 3, 2, None), ("r1", "m2", "dbl", "recv", 4, 1, "6"), ("r1", "m2", "dbl", "failure", 9, 2, None), ("r1", "m3", "sink", "recv", 9, 1, "6")]
    two = [("r2", "m1", "inc", "recv", 11, 1, "5"), ("r2", "m1", "inc", "success", 12, 2, None), ("r2", "m2", "inc", "recv", 13, 1, "new")]
    for rows in (one, two):
        sinks.store_trace(spark.createDataFrame(rows, schema), str(tmp_path / "trace"))
    read = lambda name: spark.read.parquet(str(tmp_path / "trace" / name))
    assert sorted(r["payload"] for r in read("payloads").collect()) == ["5", "6", "new"]
    assert Counter(r["status"] for r in read("spans").collect()) == {"ok": 2, "failed": 1, "open": 2}
    assert read("events").count() == 8 and read("runs").count() == 2
    figures = {r["step"]: (r["received"], r["in_flight"], r["failed"], r["slowest"]) for r in sinks.snapshot(read("spans")).collect()}
    assert figures == {"inc": (3, 1, 0, 2), "dbl": (1, 0, 1, 5), "sink": (1, 1, 0, None)}


def test_json_runs_and_observed_figures(spark, tmp_path):
    df, seen = sinks.observed(spark.range(5), "five", n=F.count("*"), most=F.max("id"))
    at = sinks.write_json_run(df, str(tmp_path), "7")
    assert seen.get == {"n": 5, "most": 4}
    assert sorted(r["id"] for r in spark.read.json(at).collect()) == list(range(5))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_json_run(df, str(tmp_path), "7")


def test_shapes_of_flows():
    diamond = [("in", "a"), ("in", "b"), ("a", "c"), ("b", "c"), ("c", "out")]
    assert topology.series_parallel(diamond, "in", "out") == "in;(a|b);c;out"
    assert topology.series_parallel([*diamond, ("a", "b")], "in", "out") is None  # a bridge
    assert topology.series_parallel([("in", "out"), ("in", "a"), ("a", "out")], "in", "out") == "in;(-|a);out"
    assert topology.cut_steps(diamond, "in", "out") == ["c"]
    loop = [("s", "x"), ("x", "y"), ("y", "x"), ("y", "t")]
    assert topology.components(loop) == {"s": "s", "x": "x", "y": "x", "t": "t"}
    assert topology.levels(loop) == {"s": 0, "x": 1, "y": 1, "t": 2} and topology.feedback(loop) == [("y", "x")]


def test_feedback_edges_leave_no_cycle():
    rng = random.Random(2)
    for _ in range(60):
        names = "abcdefg"
        edges = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(1, 16))}
        left = edges - set(topology.feedback(sorted(edges)))
        assert all(a != b for a, b in left)
        assert len(set(topology.components(left).values())) == len({n for e in left for n in e})


def test_subjects_by_enumeration(spark):
    tokens, wild = ["a", "b"], ["a", "*"]
    every = [".".join(t) for n in (1, 2, 3, 4) for t in itertools.product(tokens, repeat=n)]
    patterns = [".".join(t) for n in (1, 2, 3) for t in itertools.product(wild, repeat=n)] + [".".join([*t, ">"]) for n in (0, 1, 2) for t in itertools.product(wild, repeat=n)]
    regex = {p: re.compile(r"\.".join({"*": "[^.]+", ">": ".+"}.get(t, t) for t in p.split("."))) for p in patterns}
    takes = {p: {s for s in every if regex[p].fullmatch(s)} for p in patterns}
    pairs = spark.createDataFrame(list(itertools.product(patterns, patterns)), "p string, q string")
    for r in pairs.select("p", "q", subjects.collide(F.col("p"), F.col("q")).alias("c"), subjects.covers(F.col("p"), F.col("q")).alias("w")).collect():
        assert r["c"] == bool(takes[r["p"]] & takes[r["q"]]), r
        assert r["w"] == (takes[r["q"]] <= takes[r["p"]]), r
    known = spark.createDataFrame(list(itertools.product(every, patterns)), "s string, p string")
    assert all(r["m"] == (r["s"] in takes[r["p"]]) for r in known.select("s", "p", subjects.matches(F.col("s"), F.col("p")).alias("m")).collect())


def test_code_ranges_of_boxes():
    assert zorder.middle(123, 456) == (221, 298)
    assert zorder.ranges(3, 48) == [(3, 3), (6, 7), (9, 9), (11, 15), (18, 18), (24, 24), (26, 26), (33, 33), (36, 37), (48, 48)]
    assert zorder.litmax_bigmin(58, 27, 102) == (55, 74)
    rng = random.Random(1)
    for d in (2, 3):
        code = lambda *c: sum(((x >> k) & 1) << (len(c) * k + i) for i, x in enumerate(c) for k in range(6))
        for _ in range(40):
            box = [sorted((rng.randrange(14), rng.randrange(14))) for _ in range(d)]
            lo, hi = code(*(b[0] for b in box)), code(*(b[1] for b in box))
            codes = sorted(code(*c) for c in itertools.product(*(range(a, b + 1) for a, b in box)))
            assert [z for a, b in zorder.ranges(lo, hi, d) for z in range(a, b + 1)] == codes
            assert [z for z in range(lo, hi + 1) if zorder.inside(z, lo, hi, d)] == codes
            for z in rng.sample(sorted(set(range(lo, hi + 1)) - set(codes)), min(5, hi + 1 - lo - len(codes))):
                assert zorder.litmax_bigmin(z, lo, hi, d) == (max(c for c in codes if c < z), min(c for c in codes if c > z))


def test_trigram_model_by_dictionaries(spark):
    texts = ["a b c a b d", "a b c", "b c a", "d a b c b", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    model = language.KneserNey(df, "id", F.split("t", " "), order=3, modified=False)
    got = {r["id"]: r["perplexity"] for r in model.perplexity(df.where("id < 4"), "id", F.split("t", " ")).collect()}
    grams = lambda t, n: [tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)]
    counts = {3: Counter(g for t in texts for g in grams(t, 3))}
    for n in (2, 1):  # how many different words come before
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram: tuple) -> float:
        n = len(gram)
        if n == 1:
            return counts[1][gram] / sum(counts[1].values())
        ones, twos = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones + 2 * twos else 0.5
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        whole = sum(same.values())
        return max(same.get(gram, 0) - d, 0) / whole + d * len(same) / whole * p(gram[1:])

    for i, t in enumerate(texts[:4]):
        logs = [math.log(max(p(g), 1e-300)) for g in grams(t, 3)]
        assert abs(got[i] - math.exp(-sum(logs) / len(logs))) < 1e-6


def test_loop_stops_and_best_choice(spark):
    start = spark.range(1).select(F.lit(0).alias("v"))
    value = lambda s: {"v": s.first()[0]}
    grow = lambda s, k: s.select((F.col("v") + 1).alias("v"))
    assert recursion.iterate_until(start, grow, value, {}, most=3)[1:] == ("turns", 3)
    assert recursion.iterate_until(start, lambda s, k: s, value, {}, most=9, patience=2)[1:] == ("plateau", 3)
    assert recursion.iterate_until(start, grow, value, {"budget": lambda now, before: now["v"] >= 2}, most=9)[1:] == ("budget", 2)
    df = spark.createDataFrame([("long", 0.9, 9), ("short", 0.8, 3), ("low", 0.2, 1)], "n string, s double, l int")
    assert recursion.best_of(df, "s", "l", 0.7).first()["n"] == "short" and recursion.best_of(df, "s", "l", 0.95).first()["n"] == "long"


def test_attempts_give_up_and_recover():
    tries = []

    def call(v):
        tries.append(v)
        if len(tries) < 3:
            raise OSError("busy")
        return v * 2

    got = attempt(call, 4, base_ms=1)
    assert got["ok"] and got["value"] == 8 and got["attempts"] == 3


def test_whole_lists_of_windows(spark):
    rows = [(t, i) for i, t in enumerate((0, 50, 99, 100, 150, 200))]
    out = compose.on_window(spark.createDataFrame(rows, "t bigint, i bigint"), "t", 100, ["i"], lambda a, b, r: {"start": a, "n": len(r), "total": int((r["i"] + 1).sum())}, "start bigint, n bigint, total bigint")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 3, 6), (100, 2, 9), (200, 1, 6)]


def test_histograms_of_other_parameters_are_not_merged(spark):
    h = aggregates.histogram(spark.createDataFrame([("a", 5), ("a", 70)], "k string, v bigint"), ["k"], "v", 2, 4)
    both = aggregates.merge_histograms([(h, (2, 4)), (h, (2, 4))], ["k"])
    assert sorted(r["n"] for r in both.collect()) == [2, 2]
    with pytest.raises(ValueError, match="parameters"):
        aggregates.merge_histograms([(h, (2, 4)), (h, (2, 5))], ["k"])


def test_bulk_append_and_scans(spark):
    rows = lambda *ks: spark.createDataFrame([(k, k.upper()) for k in ks], "key string, value string")
    both = keyed.bulk_append(rows("a", "b"), rows("d", "c"))
    assert sorted(r["key"] for r in both.collect()) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="out of order"):
        keyed.bulk_append(rows("a", "c"), rows("b"))
    assert keyed.bulk_append(rows("a").where("false"), rows("b")).count() == 1
    assert [r["key"] for r in keyed.scan(both, "closed", "b", "d").collect()] == ["b", "c", "d"]
    assert [r["key"] for r in keyed.scan(both, "closed_open", "b", "d", backward=True).collect()] == ["c", "b"]


def test_derived_rows_know_their_parents(spark):
    seen = defaultdict(int)
    for r in compose.derive(spark.createDataFrame([(7, ["x", "y"])], "id bigint, kids array<string>"), "id", F.col("kids"), "kid").collect():
        seen[r["kid"]] += 1
        assert r["parent_ids"] == [7] and r["data_id"] == f"7/{r['place']}"
    assert dict(seen) == {"x": 1, "y": 1}


def test_numeric_entities(spark):
    rows = ["a&#39;b", "&#x41;&#X62;c", "&#8212; x", "&#0;", "&#xD800;", "&#1234567;", "& # &#", "plain", None, "&#233;&#39;"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.numeric_entities(F.col("t")).alias("t")).collect()]
    assert got == ["a'b", "Abc", "— x", "&#0;", "&#xD800;", "&#1234567;", "& # &#", "plain", None, "é'"]
