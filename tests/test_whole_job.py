"""Queries over whole tables and texts, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rillmill.functions.pythonic import Quotes, approximate
from rillmill.operators import aggregates as A
from rillmill.plans import registry, text
from tests.compare import DATA, assert_same, connect


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.choice((0, 1, 1))] = rng.choice(("", "x", "e", " ", "qz"))
    return "".join(out)


def test_quotes_are_found_as_by_brute_force():
    rng = random.Random(3)
    words = ["de", "a", "ser", "lima", "corta", "Así", "ción", "tren", "no"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(("", "", "na", "x")) for _ in range(n))
    quotes = [(i, prose(n), max(4, len(q) // 5)) for i, n in enumerate((1, 2, 4, 5, 8, 12, 20, 40, 60)) for q in [prose(n)]]
    quotes = [(i, q, max(4, len(q) // 5)) for i, q, _ in quotes] + [(20, "aaa aaa " * 9, 14), (21, "", 4)]
    texts = ["", "x", prose(300), "aa a " * 60] + [prose(rng.randrange(40)) + edited(rng, q, rng.randrange(k + 4)) + prose(rng.randrange(60)) for _, q, k in quotes for _ in range(12) if q]
    index, found = Quotes(quotes), 0
    for t in texts:
        want = sorted((i, *h) for i, q, k in quotes for h in approximate(t, q, k))
        assert sorted(index.hits(t)) == want
        found += len({i for i, *_ in want if i > 4})
    assert found > 40


def test_fuzzy_quotes_seeks_whole_texts(spark, tmp_path):
    whole = "we go on as far as it is to be had by us all and so on and on; it is the end of it"  # no long word
    bench = [(1, whole), (2, None), (3, "another passage, considerably different from the first"), (3, "another passage, considerably different from the first")]
    docs = [(1, "Before. " + whole.upper() + " After."), (2, whole[:40] + " 0123456789" * 6), (3, None), (4, "anothr passagexconsiderably, different fromthe first")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in registry.QUERIES["fuzzy_quotes"](spark, str(tmp_path)).collect())
    limit = lambda q: max(4, len(q) // 5)
    assert rows == sorted({(i, d, *h) for i, q in bench if q for d, t in docs if t for h in approximate(t, q, limit(q))})
    assert [r[:2] for r in rows] == [(1, 1), (3, 4)]


def test_lineage_of_every_order(spark):
    ids = {r[0] for r in connect().execute("select o_orderkey from orders").fetchall()}
    up = {i: {s for s in (i // 2, i // 3) if 0 < s < i} if i in ids else set() for i in range(max(ids) + 1)}
    want = set()
    for i in ids:
        seen, front = {i}, {i}
        while front:
            front = {s for x in front for s in up[x]} - seen
            seen |= front
        want.add((i, len(seen), min(seen), sum(seen)))
    got = {tuple(r) for r in registry.QUERIES["lineage_walk"](spark, DATA).select("target", "n", "first", "ids").collect()}
    assert got == want
    assert set(connect().execute(registry.ORACLE_SQL["lineage_walk"]).fetchall()) == got


def test_rollup_has_every_returned_item(spark):
    rows = connect().execute("select p_brand, l_shipdate, l_orderkey, l_linenumber from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R'").fetchall()
    want = {b: "" for (b,) in connect().execute("select distinct p_brand from part").fetchall()}
    for brand in want:
        want[brand] = ",".join(str(r[2]) for r in sorted(r for r in rows if r[0] == brand))
    assert {r["p_brand"]: r["records"] for r in registry.QUERIES["entity_rollup"](spark, DATA).collect()} == want


def test_month_spine_counts_cheap_orders_and_fills_gaps(spark, tmp_path):
    rows = [("1-URGENT", "2020-01-05", 10.0), ("1-URGENT", "2020-04-05", 500000.0), ("1-URGENT", "2020-04-06", 20.0), ("5-LOW", "2020-12-31", 1.0), ("5-LOW", "2021-01-01", 1.0)]
    df = spark.createDataFrame(rows, "o_orderpriority string, d string, o_totalprice double")
    df.selectExpr("o_orderpriority", "cast(d as date) as o_orderdate", "o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["o_orderpriority"], r["month"], r["n"]) for r in registry.QUERIES["month_spine"](spark, str(tmp_path)).collect())
    y = 2020 * 12
    assert got == [("1-URGENT", y, 1), ("1-URGENT", y + 1, 0), ("1-URGENT", y + 2, 0), ("1-URGENT", y + 3, 2), ("5-LOW", y + 11, 1), ("5-LOW", y + 12, 1)]


def test_keyed_joins_have_whole_lists_missing_and_null_keys(spark, tmp_path):
    tables = {
        "customer": ("c_custkey bigint, c_name string", [(1, "a"), (3, "c"), (None, "n"), (14, "x")]),
        "orders": ("o_custkey bigint, o_orderkey bigint, o_orderpriority string", [(3, k, f"p{k}") for k in (5, 1, 4, 2, 3)] + [(5, 9, "q"), (None, 8, "r")]),
        "events": ("user_id bigint, event_id bigint, event_type string", [(3, k, f"e{k}") for k in (7, 3, 5, 1)] + [(7, 2, "f"), (None, 4, "g")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda q: {r["key"]: (r["names"], r["n_orders"], r["orders"], r["n_events"], r["events"]) for r in registry.QUERIES[q](spark, str(tmp_path)).collect()}
    both = {3: ("c", 5, "p1,p2,p3,p4,p5", 4, "e1,e3,e5,e7"), None: ("n", 1, "r", 1, "g")}
    assert run("join_by_key_all") == both
    assert run("join_by_key_full") == both | {1: ("a", 0, "", 0, ""), 5: ("", 1, "q", 0, ""), 7: ("", 0, "", 1, "f"), 14: ("x", 0, "", 0, "")}


def test_upsert_puts_every_customer(spark):
    con = connect()
    want = dict(con.execute("select s_suppkey, s_name from supplier").fetchall()) | dict(con.execute("select c_custkey, c_name from customer").fetchall())
    assert {r["key"]: r["value"] for r in registry.QUERIES["kv_upsert"](spark, DATA).collect()} == want


def test_titles_meet_whole_first_sentences(spark, tmp_path):
    long = "This sentence has rather more than sixty characters, version 1.5 in it, and ends here"
    page = lambda p: f"<html><head><title>T</title></head><body>{p}</body></html>"
    rows = [(1, page(f"<p>{long}! Another.</p>")), (2, page(f'<pre>no</pre><P class="a"\nid=b>{long}</P>')), (3, page("<pre>no</pre>"))]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(tuple(r) for r in text._titles(spark, str(tmp_path)).collect()) == [(1, "T", long + "!"), (2, "T", long)]


@pytest.mark.parametrize("name", ["title_metrics", "style_features", "frequencies_zero_filled", "trajectory_terms"])
def test_larger_tables_too(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_ranks_of_groups_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGES", 4)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9), 1000]), i) for i in range(300)] + [("none", None, 300), ("one", 7, 301), ("same", 3, 302), ("same", 3, 303)]
    df = spark.createDataFrame(rows, "g string, v bigint, id bigint")
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in A.at_ranks(df, ["g"], "v", "id", {"lo": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "hi": lambda n: n - 1}).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        s = sorted((v, i) for k, v, i in rows if k == g and v is not None)
        want[g] = (s[0][1], s[len(s) // 2][1], s[-1][1]) if s else (None, None, None)
    assert got == want
