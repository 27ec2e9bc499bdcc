"""Queries on trees, lineage, traces, approximate matches, curves and loops."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.functions.curves import polyline
from rillmill.functions.pythonic import quote_hits, z_ranges
from rillmill.operators import recursion as R
from rillmill.operators.aggregates import nearest_ranks
from rillmill.sources.tables import SHARE, spread, table

FAN = 3
BOX = (20, 10, 75, 60)


def _items(spark, sf_dir):
    """Customers as a forest of messages: every tenth starts a thread, the others answer the one at a third of their number."""
    i = F.col("c_custkey")
    parent = F.when((i % 10 != 0) & (i > 0), F.floor(i / FAN))
    return table(spark, sf_dir, "customer").select(i.alias("id"), parent.alias("parent"), (1000 + i * 60 + i % 7).alias("t"), F.col("c_mktsegment").alias("label"))


def tree_paths(spark, sf_dir):
    """Root and depth of each message."""
    p = R.paths(_items(spark, sf_dir))
    return p.select("id", F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("id")).alias("root"), F.size("path").alias("depth"))


def subtree_sizes(spark, sf_dir):
    return R.subtree_sizes(R.paths(_items(spark, sf_dir)))


def thread_shape(spark, sf_dir):
    """Comments, depth, branching, latencies and length of each thread."""
    items = _items(spark, sf_dir)
    p = R.paths(items).select("id", F.coalesce(F.try_element_at("path", F.lit(-1)), F.col("id")).alias("root"), F.size("path").alias("depth"))
    rows = items.join(p, "id").join(items.select(F.col("id").alias("parent"), F.col("t").alias("tp")), "parent", "left")
    kids = rows.where("depth > 0").groupBy("root", "parent").agg(F.count("*").alias("k")).groupBy("root").agg(F.round(F.avg("k"), 6).alias("branching"), F.max("k").alias("widest"))
    late = F.when(F.col("depth") > 0, F.col("t") - F.col("tp"))
    main = rows.groupBy("root").agg(
        F.sum(F.when(F.col("depth") > 0, 1).otherwise(0)).alias("comments"),
        F.max("depth").alias("depth"),
        F.min(F.when(F.col("depth") == 1, F.col("t") - F.col("tp"))).alias("first_reply"),
        F.round((F.max(F.when(F.col("depth") > 0, F.col("t"))) - F.min(F.when(F.col("depth") == 0, F.col("t")))) / 3600.0, 6).alias("hours"),
    )
    ranks = nearest_ranks(rows.select("root", late.alias("late")), ["root"], "late", {"p50": 0.5, "p95": 0.95})
    return main.join(ranks, "root").join(kids, "root", "left")


def top_branches(spark, sf_dir):
    """The three largest branches of each thread, with their rank from 0."""
    items = _items(spark, sf_dir)
    p = R.paths(items)
    sizes = R.subtree_sizes(p).join(items.select("id", "parent"), "id").join(p.where("size(path) = 1").select("id"), "id")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("size"), "id")) - 1
    return sizes.withColumn("rank", rank).where("rank < 3").select(F.col("parent").alias("root"), "rank", "id", "size")


def parent_chain(spark, sf_dir):
    """Each message with parent, grandparent and the root of its thread, where they are; beyond six hops no root is sought."""
    p = R.paths(_items(spark, sf_dir))
    return p.select("id", F.try_element_at("path", F.lit(1)).alias("parent"), F.try_element_at("path", F.lit(2)).alias("grandparent"), F.when(F.size("path") <= 6, F.try_element_at("path", F.lit(-1))).alias("story"))


def guarded_parents(spark, sf_dir):
    """Parents that are taken up, transitively, as long as the message has the label."""
    p = R.paths(_items(spark, sf_dir), go_on=F.col("label").isin("BUILDING", "MACHINERY", "HOUSEHOLD"))
    return p.select("id", F.explode("path").alias("taken"))


def _derivations(spark, sf_dir):
    """Orders as derived rows: each comes from those at half and at a third of its number."""
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(i.alias("id"), F.explode(F.array_distinct(F.array(F.floor(i / 2), F.floor(i / 3)))).alias("source"))
    return rows.where("source > 0 and source < id")


def lineage_walk(spark, sf_dir):
    """What every order comes from: how many rows, the smallest and the sum of them."""
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return R.lineage_figures(_derivations(spark, sf_dir), targets)


def lineage_edges(spark, sf_dir):
    """Edges from parents to rows; a row of several parents is a merge."""
    merged = F.count("*").over(Window.partitionBy("id"))
    return _derivations(spark, sf_dir).select("id", "source", F.when(merged > 1, "merge").otherwise("split").alias("kind"))


def _trace(spark, sf_dir):
    """Line items as a trace: a receipt for each, and a success, a failure or nothing later on."""
    items = table(spark, sf_dir, "lineitem")
    line = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("msg_id"), F.col("l_returnflag").alias("step"), (F.col("l_partkey") % 1000).alias("d"), F.col("l_linenumber").alias("k"))
    line = spread(line, items.count() // SHARE, "msg_id").groupBy("msg_id").agg(F.min("step").alias("step"), F.min("d").alias("d"), F.min("k").alias("k"))
    t = F.col("msg_id") * 3
    ends = F.when(F.col("d") % 10 == 0, F.array()).otherwise(F.array(F.struct(F.when(F.col("d") % 10 == 1, "failure").otherwise("success").alias("kind"), (t + F.col("d")).alias("t"), F.lit(2).alias("seq"))))
    all_ = F.concat(F.array(F.struct(F.lit("recv").alias("kind"), t.alias("t"), F.lit(1).alias("seq"))), ends)
    return line.select("msg_id", "step", F.explode(all_).alias("e")).select("msg_id", "step", "e.kind", "e.t", "e.seq")


def span_pairing(spark, sf_dir):
    return R.spans(_trace(spark, sf_dir))


def span_stats(spark, sf_dir):
    """Latency and outcome by step."""
    s = R.spans(_trace(spark, sf_dir)).withColumn("took", F.col("ended") - F.col("began"))
    is_ = lambda status: F.sum(F.when(F.col("status") == status, 1).otherwise(0)).alias(status)
    return s.groupBy("step").agg(F.count("*").alias("n"), is_("ok"), is_("failed"), is_("open"), F.max("took").alias("longest"), F.round(F.avg("took"), 6).alias("mean"))


def balance_audit(spark, sf_dir):
    """Steps whose receipts and completions balance."""
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0))
    return _trace(spark, sf_dir).groupBy("step").agg(count("recv").alias("received"), count("success", "failure").alias("completed")).withColumn("balanced", F.col("received") == F.col("completed"))


def payload_dedup(spark, sf_dir):
    """Payloads stored once under the hash of their content."""
    e = table(spark, sf_dir, "events").select(F.sha2("props", 256).alias("id"), "props", "event_id")
    return e.groupBy("id").agg(F.min("props").alias("payload"), F.count("*").alias("refs"), F.min("event_id").alias("first"))


def fuzzy_quotes(spark, sf_dir):
    """Whole benchmark texts that occur in documents, give or take a fifth of their length; the benchmark is one list in each task."""
    limit = F.greatest(F.lit(4), F.length("text") / 5).cast("int")
    bench = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", "text", limit).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(quote_hits(F.col("text"), [tuple(r) for r in bench.collect()])).alias("hit"))
    return docs.select("hit.item_id", "doc_id", "hit.start", "hit.end", "hit.distance")


def _grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 128).cast("bigint").alias("x"), F.col("p_size").cast("bigint").alias("y"))
    bits = [F.shiftleft(F.shiftright("x", k).bitwiseAND(F.lit(1)), 2 * k).bitwiseOR(F.shiftleft(F.shiftright("y", k).bitwiseAND(F.lit(1)), 2 * k + 1)) for k in range(16)]
    z = bits[0]
    for b in bits[1:]:
        z = z.bitwiseOR(b)
    return p.withColumn("z", z)


def zorder_codes(spark, sf_dir):
    return _grid(spark, sf_dir)


def zorder_box(spark, sf_dir):
    """Parts within a rectangle, by a join of Morton codes with the ranges that cover it."""
    ranges = spark.createDataFrame(z_ranges(*BOX), "lo bigint, hi bigint")
    return _grid(spark, sf_dir).join(F.broadcast(ranges), F.col("z").between(F.col("lo"), F.col("hi"))).select("p_partkey", "x", "y")


def spline_points(spark, sf_dir):
    """A smooth curve through the totals of each customer's orders, in order of time."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"), "o_totalprice")
    by = Window.partitionBy("o_custkey").orderBy("t", "o_orderkey")
    pts = o.select("o_custkey", F.row_number().over(by).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return polyline(pts, ["o_custkey"], "x", "y", 4).select("o_custkey", F.col("segment"), F.col("k"), F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))


def refined_threshold(spark, sf_dir):
    """A loop that halves prices until their mean is below a target: the state, and why it ended."""
    start = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    state, reason, rounds = R.iterate_until(
        start, lambda df, k: df.withColumn("p_retailprice", F.col("p_retailprice") / 2), lambda df: {"mean": df.agg(F.avg("p_retailprice")).first()[0]}, {"target": lambda now, _: (now["mean"] or 0) < 200}, most=10
    )
    return state.agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean")).withColumns({"reason": F.lit(reason), "rounds": F.lit(rounds)})


QUERIES = {f.__name__: f for f in (
    tree_paths, subtree_sizes, thread_shape, top_branches, parent_chain, guarded_parents, lineage_walk, lineage_edges, span_pairing, span_stats, balance_audit, payload_dedup,
    fuzzy_quotes, zorder_codes, zorder_box, spline_points, refined_threshold,
)}

_ITEMS = f"""items as (select c_custkey as id, case when c_custkey % 10 <> 0 and c_custkey > 0 then c_custkey // {FAN} end as up, 1000 + c_custkey * 60 + c_custkey % 7 as t, c_mktsegment as label from customer),
     tree as (select i.id, p.id as parent, i.t, i.label from items i left join items p on i.up = p.id)"""
_CLOSURE = f"""with recursive {_ITEMS},
     up(id, anc, d) as (select id, id, 0 from tree union all select up.id, tree.parent, d + 1 from up join tree on up.anc = tree.id where tree.parent is not null)"""
_ROOTS = _CLOSURE + ", p as (select id, arg_max(anc, d) as root, max(d) as depth from up group by 1)"
_EDGES = """e as (select distinct id, source from (select o_orderkey as id, o_orderkey // 2 as source from orders union all select o_orderkey, o_orderkey // 3 from orders) where source > 0 and source < id)"""
_TRACE = """line as (select l_orderkey * 10 + l_linenumber as msg_id, min(l_returnflag) as step, min(l_partkey % 1000) as d from lineitem group by 1),
     span as (select msg_id, step, msg_id * 3 as began, case when d % 10 <> 0 then msg_id * 3 + d end as ended, case when d % 10 = 0 then 'open' when d % 10 = 1 then 'failed' else 'ok' end as status from line)"""
_RANK = lambda p: f"list_sort(late)[least(len(late) - 1, cast(floor({p} * len(late)) as bigint)) + 1]"
_GRID = "select p_partkey, p_partkey % 128 as x, cast(p_size as bigint) as y from part"

ORACLE_SQL = {
    "tree_paths": f"{_ROOTS} select * from p",
    "subtree_sizes": f"{_CLOSURE} select anc as id, count(*) as size, max(d) as height from up group by 1",
    "thread_shape": f"""{_ROOTS},
     r as (select tree.id, tree.parent, tree.t, p.root, p.depth, q.t as tp from tree join p using (id) left join tree q on tree.parent = q.id),
     k as (select root, round(avg(k), 6) as branching, max(k) as widest from (select root, parent, count(*) as k from r where depth > 0 group by 1, 2) group by 1),
     m as (select root, count(*) filter (depth > 0) as comments, max(depth) as depth, min(t - tp) filter (depth = 1) as first_reply,
                  round((max(t) filter (depth > 0) - min(t) filter (depth = 0)) / 3600.0, 6) as hours, list(t - tp) filter (depth > 0) as late from r group by 1)
select m.root, comments, depth, first_reply, hours, {_RANK(0.5)} as p50, {_RANK(0.95)} as p95, branching, widest from m left join k using (root)""",
    "top_branches": f"""{_CLOSURE}, s as (select anc as id, count(*) as size from up group by 1), d as (select id, max(d) as depth from up group by 1),
     k as (select parent as root, row_number() over (partition by parent order by size desc, id) - 1 as rank, id, size from s join d using (id) join tree using (id) where depth = 1)
select * from k where rank < 3""",
    "parent_chain": f"""{_CLOSURE} select id, max(anc) filter (d = 1) as parent, max(anc) filter (d = 2) as grandparent, case when max(d) <= 6 then arg_max(anc, d) filter (d > 0) end as story from up group by 1""",
    "guarded_parents": f"""with recursive {_ITEMS},
     up(id, anc) as (select id, parent from tree where parent is not null and label in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
                     union all select up.id, tree.parent from up join tree on up.anc = tree.id where tree.parent is not null and label in ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
select id, anc as taken from up""",
    "lineage_walk": f"""with recursive {_EDGES},
     w(target, id) as (select o_orderkey, o_orderkey from orders union select w.target, e.source from w join e using (id))
select target, count(*) as n, min(id) as first, cast(sum(id) as bigint) as ids from w group by 1""",
    "lineage_edges": f"with {_EDGES} select id, source, case when count(*) over (partition by id) > 1 then 'merge' else 'split' end as kind from e",
    "span_pairing": f"with {_TRACE} select * from span",
    "span_stats": f"""with {_TRACE} select step, count(*) as n, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'open') as open,
       max(ended - began) as longest, round(avg(ended - began), 6) as mean from span group by 1""",
    "balance_audit": f"with {_TRACE} select step, count(*) as received, count(*) filter (status <> 'open') as completed, count(*) = count(*) filter (status <> 'open') as balanced from span group by 1",
    "payload_dedup": "select sha256(props) as id, min(props) as payload, count(*) as refs, min(event_id) as first from events group by 1",
    "zorder_codes": f"select *, cast(list_sum([(((x >> k) & 1) << (2 * k)) + (((y >> k) & 1) << (2 * k + 1)) for k in range(16)]) as bigint) as z from ({_GRID})",
    "zorder_box": f"select * from ({_GRID}) where x between {BOX[0]} and {BOX[2]} and y between {BOX[1]} and {BOX[3]}",
    "spline_points": """
with p as (select o_custkey, cast(row_number() over w as double) as x, o_totalprice as y from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
     s as (select o_custkey, x as x1, y as y1, coalesce(lag(x) over w, x) as x0, coalesce(lag(y) over w, y) as y0, lead(x) over w as x2, lead(y) over w as y2,
                  coalesce(lead(x, 2) over w, lead(x) over w) as x3, coalesce(lead(y, 2) over w, lead(y) over w) as y3, row_number() over w - 1 as segment from p window w as (partition by o_custkey order by x)),
     k as (select *, unnest(range(5)) as k from s where x2 is not null), t as (select *, cast(k as double) / 4 as t from k)
select o_custkey, segment, k,
       round(0.5 * (2 * x1 + (x2 - x0) * t + (2 * x0 - 5 * x1 + 4 * x2 - x3) * t * t + (3 * x1 - x0 - 3 * x2 + x3) * t * t * t), 9) as px,
       round(0.5 * (2 * y1 + (y2 - y0) * t + (2 * y0 - 5 * y1 + 4 * y2 - y3) * t * t + (3 * y1 - y0 - 3 * y2 + y3) * t * t * t), 9) as py
from t""",
    "refined_threshold": """
with r as (select count(*) as n, avg(p_retailprice) as m, unnest(range(1, 11)) as k from part group by all),
     s as (select count(*) as n, avg(p_retailprice) as m from part),
     h as (select n, m / pow(2, k) as mean, k from s, (select unnest(range(1, 11)) as k))
select n, round(mean, 6) as mean, 'target' as reason, cast(k as integer) as rounds from h where mean < 200 order by k limit 1""",
}
