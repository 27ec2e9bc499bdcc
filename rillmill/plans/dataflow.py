"""Queries on composition, attribution, user functions over groups, facets, subjects and codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.functions import subjects as U
from rillmill.functions import text as X
from rillmill.functions import zorder
from rillmill.functions.times import seconds
from rillmill.operators import aggregates as A
from rillmill.operators import compose as C
from rillmill.operators import language as L
from rillmill.operators import topology
from rillmill.plans.joining import ORACLE_SQL as JOINING_SQL
from rillmill.sources import sinks
from rillmill.sources.tables import SHARE, spread, table

DAY = 86400
PATTERNS = ("en.*", "*.src0", ">", "de.>", "en.src0", "*.*", "fr.src1.*", "*.>", "en.src0.more")
DIRTY = ("en", "en.src0", "en..x", ".en", "en.>.x", "en.*", ">", "a b", "")


def derived_words(spark, sf_dir):
    """A child for each word of a part's name, with its parent's id and a data id of its own."""
    p = C.derive(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", F.split("p_name", " "), "word")
    return C.passed(p, word=F.upper("word")).select(F.array_join("parent_ids", ",").alias("parents"), "data_id", "place", "word")


def outputs_by_input(spark, sf_dir):
    """Every order with the large items that it led to, none for most; an item is an output of its order and, if it was returned, of the one before, too."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    back = F.when(F.col("l_returnflag") == "R", F.col("l_orderkey") - 1)
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.array_compact(F.array("l_orderkey", back)).alias("sources"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("value"))
    out = C.outputs_by_input(o, li, "o_orderkey", "sources", "value")
    return out.select("o_orderkey", F.size("outputs").alias("n"), F.array_join("outputs", ",").alias("outputs"))


def scatter_gather(spark, sf_dir):
    """Three branches on each event, one of them for purchases only, gathered in a struct."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", seconds("ts").alias("t"))
    g = C.scatter_gather(e, {"day": F.floor(F.col("t") / DAY), "shout": F.upper("event_type"), "buyer": F.col("user_id")}, {"buyer": F.col("event_type") == "purchase"})
    return g.select("event_id", F.col("gathered.day").alias("day"), F.col("gathered.shout").alias("shout"), F.col("gathered.buyer").alias("buyer"))


def fan_out_in(spark, sf_dir):
    """Orders fanned out to ports and gathered by customer: a map of what arrived at each port."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    rows = C.fan_out(o, "o_custkey", {"all": F.col("o_orderkey"), "open": F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))}).where("value is not null")
    m = C.fan_in(rows, "o_custkey")
    text = lambda port: F.coalesce(F.array_join(F.try_element_at("arrived", F.lit(port)).cast("array<string>"), ","), F.lit(""))
    return m.select("o_custkey", text("all").alias("all"), text("open").alias("open"))


def summarized_rows(spark, sf_dir):
    """An opaque summary of each user's events in order: the longest run of one type."""

    def longest(key: tuple, rows: C.Rows) -> dict:
        kind = rows["event_type"]
        edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
        return {"user_id": key[0], "n": len(rows), "longest": int(np.diff(edges).max())}

    return C.summarize_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], longest, "user_id bigint, n bigint, longest bigint")


def matched_sides(spark, sf_dir):
    """A function of both sides of a key: a customer's orders and, as a user, events; keys on one side only have a row, too."""

    def match(key: tuple, left: C.Rows, right: C.Rows) -> list[dict]:
        return [{"key": key[0], "orders": len(left), "events": len(right), "first": min((i for i in right["event_id"] if i is not None), default=-1)}]

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    return C.on_match(o, e, "key", match, "key bigint, orders bigint, events bigint, first bigint")


def handled_windows(spark, sf_dir):
    """A function of each day's events of a user: first and last type."""

    def handle(start: int, end: int, rows: C.Rows) -> dict:
        kind = rows["event_type"]
        return {"user_id": rows["user_id"][0], "start": start, "end": end, "opened": kind[0], "closed": kind[-1]}

    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("t"))
    return C.on_window(e, "t", DAY, ["event_id"], handle, "user_id bigint, start bigint, end bigint, opened string, closed string", ("user_id",))


def cached_scores(spark, sf_dir):
    """Turns scored by a stand-in for a model, of which the first turns' scores are in the cache already; it has no opinion on texts that end in a question mark."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    opinion = F.when(~F.coalesce(F.endswith("text", F.lit("?")), F.lit(False)), (F.length("text") % 11).cast("double"))
    cache = t.where("turn = 0").groupBy(F.sha2("text", 256).alias("key")).agg(F.first(opinion).alias("score")).where("score is not null")
    out, _ = C.with_cache(t, "text", cache, lambda text: None if text.endswith("?") else float(len(text) % 11))
    return out.select("conv_id", "turn", "score")


def confident_only(spark, sf_dir):
    """Documents whose label, standing in for a judge, says good and not toxic; a missing opinion is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where((F.coalesce("quality", F.lit(0)) >= 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id", "source")


def paced_events(spark, sf_dir):
    """When a token bucket of 3, refilled once an hour, lets each user's events pass."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("t"))
    return C.paced(e, "user_id", "t", "event_id", 1 / 3600, 3).select("user_id", "event_id", F.round(F.col("released") - F.col("t")).cast("bigint").alias("waited"))


def top_items(spark, sf_dir):
    """Ids of the 30 dearest orders, then the items by these ids, each with its order's rank."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
    ids = o.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return ids.join(li, "o_orderkey").select("rank", "o_orderkey", "l_linenumber", "l_partkey")


def paged_search(spark, sf_dir):
    """The 120 shortest English documents that have a certain word part, by pages of 20."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "text")
    hits = C.paged(d, (F.col("lang") == "en") & F.contains(F.lower("text"), F.lit("the")), [F.col("n_chars"), F.col("doc_id")], 20, 120)
    return hits.select("doc_id", "page")


def facet_counts(spark, sf_dir):
    """Number of documents with a term in each range of ids, both ends included; 0 where there is none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    terms, edges = ("license", "password", "you"), ((0, 99), (99, 199), (200, 499), (10**9, 10**9 + 5))
    hits = [F.count_if(F.contains("low", F.lit(t)) & F.col("doc_id").between(lo, hi)).alias(f"{t}_{k}") for t in terms for k, (lo, hi) in enumerate(edges)]
    one = d.agg(*hits)
    cells = [F.struct(F.lit(t).alias("term"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"), F.col(f"{t}_{k}").alias("n")) for t in terms for k, (lo, hi) in enumerate(edges)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def last_day_top(spark, sf_dir):
    """The ten greatest purchases of the last 24 hours that the table has; now is its latest time."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    now = e.agg(F.max("ts").alias("now"))
    new = e.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("interval 24 hours")).where("event_type = 'purchase'")
    return new.orderBy(F.desc("value"), "event_id").limit(10).select("event_id", F.round("value", 6).alias("value"))


def first_words(spark, sf_dir):
    """The first three words of each part's name, in their order."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.first_n(F.split("p_name", " "), 3), " ").alias("first"))


def id_seconds(spark, sf_dir):
    """Seconds parsed from ids such as t96-23, null for other ids; items of a part in that order."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") < 7, F.concat(F.lit("t"), F.col("l_orderkey") % 5000, F.lit("-"), "l_linenumber")).otherwise(F.concat(F.lit("p"), "l_linenumber")).alias("id"))
    at = F.regexp_extract("id", r"^t(\d+)-\d+$", 1)
    rows = li.withColumn("at", F.when(at != "", at.cast("bigint")))
    lists = rows.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(-1)).alias("at"), "id"))).alias("l"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")).join(lists, "l_partkey", "left")
    return known.select("l_partkey", F.coalesce(F.array_join("l.id", ","), F.lit("")).alias("ids"))


def sorted_frontier(spark, sf_dir):
    """The skyline of parts, cheap and large, with the place of each by price."""
    s = A.skyline(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), {"p_retailprice": "min", "p_size": "max"}, "p_partkey")
    return s.select((F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")) - 1).alias("place"), "p_partkey")  # what is left of a skyline is small


def h2_profile(spark, sf_dir):
    """p50 to p9999 of each histogram in one row."""
    cents = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("v"))
    ps = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}
    long = A.histogram_percentiles(A.histogram(cents, ["l_returnflag"], "v", 2, 4), ["l_returnflag"], list(ps.values()), 2, 4)
    return long.groupBy("l_returnflag").agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(k) for k, p in ps.items()))


def transitions(spark, sf_dir):
    """The types of events as a graph: how often one follows another in a user's day, and whether the way leads back."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(seconds("ts") / DAY).alias("day"))
    follow = F.lead("event_type").over(Window.partitionBy("user_id", "day").orderBy("event_id"))
    edges = e.withColumn("to", follow).where("to is not null").groupBy(F.col("event_type").alias("from"), "to").agg(F.count("*").alias("n"))
    back = edges.select(F.col("from").alias("to"), F.col("to").alias("from"), F.lit(True).alias("back"))
    return edges.join(back, ["from", "to"], "left").select("from", "to", "n", F.coalesce("back", F.lit(False)).alias("back"))


def pattern_collisions(spark, sf_dir):
    """Which patterns of a fixed list some subject would match both of, and which take another in whole."""
    p = spark.createDataFrame([(x,) for x in PATTERNS], "a string").withColumn("b", F.explode(F.array(*map(F.lit, PATTERNS))))
    return p.select("a", "b", U.collide(F.col("a"), F.col("b")).alias("collide"), U.covers(F.col("a"), F.col("b")).alias("covers"))


def subject_checks(spark, sf_dir):
    """Which of some strings are subjects, and which are patterns."""
    d = spark.createDataFrame([(x,) for x in DIRTY], "s string")
    return d.select("s", U.valid_subject(F.col("s")).alias("subject"), U.valid_pattern(F.col("s")).alias("pattern"))


def matched_subjects(spark, sf_dir):
    """Documents' subjects (language and source) by the patterns that take them in, token by token."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws(".", "lang", "source").alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))
    d = d.withColumn("pattern", F.explode(F.array(*map(F.lit, PATTERNS))))
    return d.where(U.matches(F.col("subject"), F.col("pattern"))).groupBy("pattern").agg(F.count("*").alias("subjects"), F.sum("n").alias("documents"))


def zorder_space(spark, sf_dir):
    """Codes of three coordinates of each part, and what they decode to."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 512).alias("x"), F.col("p_size").cast("bigint").alias("y"), (F.floor("p_retailprice") % 1024).alias("z"))
    p = p.withColumn("code", zorder.encode([F.col("x"), F.col("y"), F.col("z")], 10))
    x, y, z = zorder.decode(F.col("code"), 3, 10)
    return p.select("p_partkey", "code", x.alias("x"), y.alias("y"), z.alias("z"))


def zorder_range_scan(spark, sf_dir):
    """Parts in a box of two coordinates, found by the runs of codes that the box covers, as a join of ranges on sorted codes would."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 128).alias("x"), F.col("p_size").cast("bigint").alias("y"))
    p = p.withColumn("code", zorder.encode([F.col("x"), F.col("y")], 8))
    code = lambda x, y: sum(((x >> k) & 1) << (2 * k) | ((y >> k) & 1) << (2 * k + 1) for k in range(8))
    runs = spark.createDataFrame(zorder.ranges(code(17, 9), code(90, 33)), "lo bigint, hi bigint")
    return p.join(F.broadcast(runs), F.col("code").between(F.col("lo"), F.col("hi"))).select("p_partkey", "x", "y")  # the box alone bounds the number of runs


FLOW_STEPS = {"docs": "source", "clean": "map", "dedup": "stateful", "score": "call", "retry": "route", "mix": "aggregate", "audit": "map", "pack": "sink"}
FLOW_EDGES = [("docs", "clean"), ("clean", "dedup"), ("clean", "audit"), ("dedup", "score"), ("score", "retry"), ("retry", "score"), ("retry", "mix"), ("audit", "mix"), ("mix", "pack")]


def flow_steps(spark, sf_dir):
    """The steps of a declared flow with their component and level."""
    return topology.tables(spark, FLOW_STEPS, FLOW_EDGES)[0]


def flow_edges(spark, sf_dir):
    return topology.tables(spark, FLOW_STEPS, FLOW_EDGES)[1]


def _trace(spark, sf_dir):
    """Orders as runs by status, with their items' receipts and ends as messages and their flags as payloads."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    li = spread(items, _shares(spark, sf_dir), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("run_id"), seconds("o_orderdate").alias("t"))
    m = li.join(o, "l_orderkey").select("run_id", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("msg_id"), F.concat(F.lit("line"), "l_linenumber").alias("step"), "t", "part", F.concat_ws(":", "flag", F.col("part") % 50).alias("payload"))
    ends = F.when(F.col("part") % 10 == 0, F.array("_recv")).otherwise(F.array("_recv", F.struct(F.when(F.col("part") % 10 == 1, "failure").otherwise("success").alias("kind"), (F.col("t") + F.col("part") % 100).alias("t"), F.lit(2).alias("seq"))))
    m = m.withColumn("_recv", F.struct(F.lit("recv").alias("kind"), "t", F.lit(1).alias("seq"))).withColumn("_e", F.explode(ends))
    return m.select("run_id", "msg_id", "step", "_e.kind", "_e.t", "_e.seq", F.when(F.col("_e.seq") == 1, F.col("payload")).alias("payload"))


def _shares(spark, sf_dir) -> int:
    """Into how many partitions the items of the trace are dealt out."""
    return table(spark, sf_dir, "lineitem").count() // SHARE


def trace_runs(spark, sf_dir):
    return sinks.trace_tables(_trace(spark, sf_dir))["runs"]


def trace_payloads(spark, sf_dir):
    return sinks.trace_tables(_trace(spark, sf_dir))["payloads"]


def trace_snapshot(spark, sf_dir):
    """What is in flight, failed and slowest by step."""
    return sinks.snapshot(sinks.trace_tables(spread(_trace(spark, sf_dir), _shares(spark, sf_dir), "run_id", "msg_id"))["spans"])


def trigram_perplexity(spark, sf_dir):
    """Perplexity of each benchmark text under a trigram model of the documents with one discount for each order."""
    model = L.KneserNey(table(spark, sf_dir, "documents"), "doc_id", X.tokens(F.col("text")), order=3, modified=False)
    return model.perplexity(table(spark, sf_dir, "benchmark"), "item_id", X.tokens(F.col("text"))).select("item_id", "n", F.round("perplexity", 4).alias("perplexity"))


QUERIES = {f.__name__: f for f in (
    flow_steps, flow_edges, trace_runs, trace_payloads, trace_snapshot, trigram_perplexity,
    derived_words, outputs_by_input, scatter_gather, fan_out_in, summarized_rows, matched_sides, handled_windows, cached_scores, confident_only, paced_events, top_items, paged_search, facet_counts, last_day_top,
    first_words, id_seconds, sorted_frontier, h2_profile, transitions, pattern_collisions, subject_checks, matched_subjects, zorder_space, zorder_range_scan,
)}

_T = "cast(floor(epoch_us(ts) / 1000000.0) as bigint)"
_regex = lambda p: "^" + "\\.".join({"*": "[^.]+", ">": ".+"}.get(t, t) for t in p.split(".")) + "$"
# all subjects of up to four tokens, of those that the patterns name and one more
_TOKENS = sorted({t for p in PATTERNS for t in p.split(".")} - {"*", ">"} | {"zz"})
_LIST = ", ".join(f"'{t}'" for t in _TOKENS)
_SUBJECTS = f"""t as (select unnest([{_LIST}]) as x), s as (select x as s from t union all select a.x || '.' || b.x from t a, t b union all select a.x || '.' || b.x || '.' || c.x from t a, t b, t c
     union all select a.x || '.' || b.x || '.' || c.x || '.' || d.x from t a, t b, t c, t d)"""
_PATTERNS = "p(p, r) as (values " + ", ".join(f"('{p}', '{_regex(p)}')" for p in PATTERNS) + ")"

_FLOW = "e(a, b) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in FLOW_EDGES) + "), s(step, kind) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in FLOW_STEPS.items()) + ")"
_REACH = f"with recursive {_FLOW}, r(a, b) as (select step, step from s union select r.a, e.b from r join e on r.b = e.a), c as (select x.a as step, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by 1)"
_RUNS = """m as (select o_orderstatus as run_id, l_orderkey, l_linenumber, cast(floor(epoch_us(o_orderdate) / 1000000.0) as bigint) as t, part, flag || ':' || part % 50 as payload
           from (select l_orderkey, l_linenumber, min(l_returnflag) as flag, min(l_partkey) as part from lineitem group by 1, 2) join orders on o_orderkey = l_orderkey)"""

ORACLE_SQL = {
    "flow_steps": f"""{_REACH}, ce as (select distinct x.component as a, y.component as b from e join c x on x.step = e.a join c y on y.step = e.b where x.component <> y.component),
     l(c, n) as (select distinct component, 0 from c union select ce.b, n + 1 from l join ce on ce.a = l.c)
select s.step, kind, component, (select max(n) from l where l.c = component) as level, cast((select count(*) from e where b = s.step) as integer) as ins, cast((select count(*) from e where a = s.step) as integer) as outs from s join c using (step)""",
    "flow_edges": f"{_REACH} select e.a as source, e.b as target, x.component = y.component and e.a = 'retry' as feedback from e join c x on x.step = e.a join c y on y.step = e.b",
    "trace_runs": f"""with {_RUNS}, v as (select run_id, t from m union all select run_id, t + part % 100 from m where part % 10 <> 0)
select run_id, min(t) as began, max(t) as ended, count(*) as events from v group by 1""",
    "trace_payloads": f"with {_RUNS} select distinct sha256(payload) as payload_id, payload from m",
    "trace_snapshot": f"""with {_RUNS} select 'line' || l_linenumber as step, count(*) as received, count(*) filter (part % 10 = 0) as in_flight, count(*) filter (part % 10 = 1) as failed,
       max(part % 100) filter (part % 10 <> 0) as slowest, round(avg(part % 100) filter (part % 10 <> 0), 6) as mean from m group by 1""",
    "derived_words": "select cast(p_partkey as varchar) || '/' || cast(i - 1 as varchar) as parents, cast(p_partkey as varchar) || '/' || cast(i - 1 as varchar) as data_id, cast(i - 1 as integer) as place, upper(w[i]) as word from (select p_partkey, w, unnest(range(1, len(w) + 1)) as i from (select p_partkey, string_split(p_name, ' ') as w from part))",
    "outputs_by_input": """
with v as (select l_orderkey as k, l_orderkey || '-' || l_linenumber || '-' || l_partkey as v, l_returnflag from lineitem where l_quantity >= 48),
     s as (select k, v from v union all select k - 1, v from v where l_returnflag = 'R'),
     l as (select k, list(v order by v) as l from s group by 1)
select o_orderkey, cast(coalesce(len(l), 0) as integer) as n, coalesce(array_to_string(l, ','), '') as outputs from orders left join l on k = o_orderkey""",
    "scatter_gather": f"select event_id, {_T} // {DAY} as day, upper(event_type) as shout, case when event_type = 'purchase' then user_id end as buyer from events",
    "fan_out_in": "select o_custkey, string_agg(o_orderkey, ',' order by o_orderkey) as all, coalesce(string_agg(o_orderkey, ',' order by o_orderkey) filter (o_orderstatus = 'O'), '') as open from orders group by 1".replace(" as all", ' as "all"'),
    "summarized_rows": """
with g as (select user_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as run from events),
     r as (select user_id, count(*) as n from g group by user_id, event_type, run)
select user_id, cast(sum(n) as bigint) as n, max(n) as longest from r group by 1""",
    "matched_sides": """
with o as (select o_custkey as key, count(*) as n from orders group by 1), e as (select user_id as key, count(*) as n, min(event_id) as first from events group by 1)
select coalesce(o.key, e.key) as key, coalesce(o.n, 0) as orders, coalesce(e.n, 0) as events, coalesce(first, -1) as first from o full join e on o.key = e.key""",
    "handled_windows": f"""
select user_id, {_T} // {DAY} * {DAY} as start, {_T} // {DAY} * {DAY} + {DAY} as "end", arg_min(event_type, event_id) as opened, arg_max(event_type, event_id) as closed from events group by 1, 2, 3""",
    "cached_scores": "select conv_id, turn, case when text not like '%?' then cast(length(text) % 11 as double) end as score from conversations",
    "confident_only": "select doc_id, source from documents join labels using (doc_id) where quality >= 1 and coalesce(toxic, 0) = 0",
    "top_items": """
with o as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as rank from orders)
select cast(rank as integer) as rank, o_orderkey, l_linenumber, l_partkey from o join lineitem on l_orderkey = o_orderkey where rank < 30""",
    "paged_search": """
select doc_id, cast((row_number() over (order by n_chars, doc_id) - 1) // 20 as integer) as page from documents where lang = 'en' and contains(lower(text), 'the') order by n_chars, doc_id limit 120""",
    "facet_counts": """
select term, lo, hi, (select count(*) from documents where contains(lower(text), term) and doc_id between lo and hi) as n
from (values ('license'), ('password'), ('you')) t(term), (values (0::bigint, 99::bigint), (99, 199), (200, 499), (1000000000, 1000000005)) r(lo, hi)""",
    "last_day_top": "select event_id, round(value, 6) as value from events where event_type = 'purchase' and ts >= (select max(ts) from events) - interval 24 hours order by events.value desc, event_id limit 10",
    "first_words": "select p_partkey, array_to_string(string_split(p_name, ' ')[1:3], ' ') as first from part",
    "id_seconds": """
with i as (select l_partkey, case when l_linenumber < 7 then 't' || l_orderkey % 5000 || '-' || l_linenumber else 'p' || l_linenumber end as id from lineitem),
     a as (select *, coalesce(try_cast(nullif(regexp_extract(id, '^t(\\d+)-\\d+$', 1), '') as bigint), -1) as sec from i)
select p_partkey as l_partkey, coalesce(string_agg(id, ',' order by sec, id), '') as ids from part left join a on l_partkey = p_partkey group by 1""",
    "sorted_frontier": """
with s as (select p_partkey, p_retailprice from part a where not exists (
  select 1 from part b where b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size or b.p_partkey < a.p_partkey)))
select cast(row_number() over (order by p_retailprice, p_partkey) - 1 as integer) as place, p_partkey from s""",
    "h2_profile": "select l_returnflag, " + ", ".join(f"max(value) filter (p = {p}::double) as {k}" for k, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999), ("p9999", 0.9999)))
    + " from (" + JOINING_SQL["h2_percentiles"].replace("(0.999::double))", "(0.999::double), (0.9999::double))") + ") group by 1",
    "transitions": f"""
with n as (select event_type as a, lead(event_type) over (partition by user_id, {_T} // {DAY} order by event_id) as b from events), e as (select a, b, count(*) as n from n where b is not null group by 1, 2)
select a as "from", b as "to", n, exists (select 1 from e x where x.a = e.b and x.b = e.a) as back from e""",
    "pattern_collisions": f"""
with {_SUBJECTS}, {_PATTERNS}, m as (select p.p, s.s from p join s on regexp_matches(s.s, r))
select a.p as a, b.p as b, exists (select 1 from m x join m y on x.s = y.s where x.p = a.p and y.p = b.p) as collide,
       not exists (select 1 from m y where y.p = b.p and y.s not in (select s from m x where x.p = a.p)) as covers from p a, p b""",
    "subject_checks": "select * from (values " + ", ".join(f"('{s}', {str(s in ('en', 'en.src0')).lower()}, {str(s in ('en', 'en.src0', 'en.*', '>')).lower()})" for s in DIRTY) + ") t(s, subject, pattern)",
    "matched_subjects": f"""
with {_PATTERNS}, d as (select concat_ws('.', lang, source) as subject, count(*) as n from documents group by 1)
select p as pattern, count(*) as subjects, cast(sum(n) as bigint) as documents from p join d on regexp_matches(subject, r) group by 1""",
    "zorder_space": """
with p as (select p_partkey, p_partkey % 512 as x, cast(p_size as bigint) as y, cast(floor(p_retailprice) as bigint) % 1024 as z from part)
select p_partkey, cast(list_sum([(((x >> k) & 1) << (3 * k)) + (((y >> k) & 1) << (3 * k + 1)) + (((z >> k) & 1) << (3 * k + 2)) for k in range(10)]) as bigint) as code, x, y, z from p""",
    "zorder_range_scan": "select p_partkey, p_partkey % 128 as x, cast(p_size as bigint) as y from part where p_partkey % 128 between 17 and 90 and p_size between 9 and 33",
}
