"""Queries on projection, routing, selection, ranges and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmill.operators import aggregates as A
from rillmill.operators import route as R
from rillmill.sources import keyed
from rillmill.sources.tables import table


def route_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ports = {"browse": F.col("event_type").isin("click", "view"), "sale": F.col("event_type") == "purchase", "fault": F.col("event_type") == "error"}
    return R.route(ev, ports).select("port", "event_id", "user_id")


def dedup_first(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return R.keep_first(ev, ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


def topk_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


def global_top_m(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "o_custkey").limit(20)


def priority_sort(spark, sf_dir):
    """The 50 first by a rank of priorities, unknown ones last, then by price: the order is in the column pos."""
    rank = F.create_map(*[F.lit(x) for kv in (("1-URGENT", 0), ("2-HIGH", 1), ("3-MEDIUM", 2)) for x in kv])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    first = o.withColumn("rank", F.coalesce(rank[F.col("o_orderpriority")], F.lit(99))).orderBy("rank", F.desc(F.coalesce("o_totalprice", F.lit(0.0))), "o_orderkey").limit(50)
    pos = F.monotonically_increasing_id()  # after a global limit there is one partition, in order
    return first.coalesce(1).select(pos.alias("pos"), "o_orderkey", "rank")


def min_median_max(spark, sf_dir):
    """Least, middle and greatest order of each priority by price."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    places = {"least": lambda n: n * 0, "middle": lambda n: F.floor(n / 2), "greatest": lambda n: n - 1}
    return A.at_ranks(o, ["o_orderpriority"], "o_totalprice", "o_orderkey", places)


def closest_to_mean(spark, sf_dir):
    """Five customers of each nation by distance of balance from its mean minus distance of key from its mean."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("double").alias("b"))
    m = c.groupBy("c_nationkey").agg((F.sum(F.round(F.col("b") * 100).cast("bigint")) / F.count("*") / 100).alias("mb"), (F.sum("c_custkey") / F.count("*")).alias("mk"))
    key = F.round(F.abs(F.col("b") - F.col("mb")) - F.abs(F.col("c_custkey") - F.col("mk")), 4)
    return R.top_per_group(c.join(m, "c_nationkey").withColumn("k", key), ["c_nationkey"], [F.col("k"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank")


def take_last(spark, sf_dir):
    """The last five events of each user, in order, as text."""
    e = R.top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 5)
    last = F.array_sort(F.collect_list("event_id"))
    return e.groupBy("user_id").agg(F.array_join(last.cast("array<string>"), ",").alias("last"))


def cross_terms(spark, sf_dir):
    """Terms by months with the number of orders: an exhaustive grid, zeros included."""
    o = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderpriority").alias("term"))
    lo_hi = o.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = lo_hi.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    grid = o.select("term").distinct().crossJoin(F.broadcast(months))
    n = o.groupBy("term", "month").agg(F.count("*").alias("n"))
    return grid.join(n, ["term", "month"], "left").select("term", F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def explode_ranked(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("rank", "word"))


def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.clip(F.col("text"), 40).alias("clipped"))


def valid_partition(spark, sf_dir):
    """Line items as valid or rejected, with the reason: the part must exist and the discount be at most a tenth."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    small = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "unknown part").when(F.round("l_discount", 2) > 0.07, "discount")
    out = li.join(small, "l_partkey", "left").withColumn("reason", reason)
    return out.groupBy(F.when(F.col("reason").isNull(), "valid").otherwise("rejected").alias("side"), "reason").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def text_windows(spark, sf_dir):
    """Turns in chunks of two with one turn of context before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return R.in_chunks(t, "turn", ["conv_id"], 2, 1).select("conv_id", "chunk", "turn", "is_focus")


def sample_rows(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 25, 42)


def bag_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    cents = F.round(F.col("balance") * 100).cast("bigint")
    return s.unionByName(c).groupBy("nation").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


def token_sets(spark, sf_dir):
    """Union, intersection and Jaccard similarity of the words of consecutive parts' names."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("w"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("v"))
    both, shared = F.size(F.array_union("w", "v")), F.size(F.array_intersect("w", "v"))
    return p.join(q, "p_partkey").select("p_partkey", both.alias("either"), shared.alias("shared"), F.round(F.coalesce(F.try_divide(shared, both), F.lit(0.0)), 6).alias("jaccard"))


def keyed_intersection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return c.join(table(spark, sf_dir, "events").select(F.col("user_id").alias("key")), "key", "left_semi")


def kv_range_scans(spark, sf_dir):
    """Count, first and last key of each kind of range over customer names, in byte order."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))
    specs = [("all",), ("at_least", "Customer#000000700"), ("at_most", "Customer#000000700"), ("greater_than", "Customer#000000700"), ("less_than", "Customer#000000700"),
             ("closed", "Customer#000000100", "Customer#000000200"), ("closed_open", "Customer#000000100", "Customer#000000200"), ("open_closed", "Customer#000000100", "Customer#000000200"),
             ("open", "Customer#000000100", "Customer#000000200"), ("prefix", "Customer#0000003")]
    hits = F.array_compact(F.array(*[F.when(keyed.in_range(F.col("key"), *s), F.lit(s[0])) for s in specs]))
    out = c.withColumn("spec", F.explode(hits)).groupBy("spec")
    return out.agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


def kv_upsert(spark, sf_dir):
    """Suppliers' balances with customers' put over them by key; the later write wins."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return keyed.put(old, new)


def kv_put_new(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return keyed.put_new(old, new)


def kv_delete(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return keyed.delete(old, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


def pruned_scan(spark, sf_dir):
    """Two columns and a pushed filter: the plan reads nothing else."""
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_quantity")


def sampled_then_filtered(spark, sf_dir):
    """Over-sample, filter, cut: of the first 40 events of each user the purchases, at most 10."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = R.top_per_group(e, ["user_id"], [F.col("event_id")], 40).drop("rank").where("event_type = 'purchase'")
    return R.top_per_group(first, ["user_id"], [F.col("event_id")], 10).select("user_id", "event_id", "rank")


def log_spaced_targets(spark, sf_dir):
    """Doubling lengths from 8 up to each nation's number of customers, which is the last."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("most"))
    steps = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.least(F.pow(F.lit(2), k + 3).cast("bigint"), F.col("most"))))
    return n.select("c_nationkey", F.array_join(steps.cast("array<string>"), ",").alias("targets"))


QUERIES = {f.__name__: f for f in (
    route_split, dedup_first, distinct_pairs, topk_per_group, global_top_m, priority_sort, min_median_max, closest_to_mean, take_last, cross_terms, explode_ranked, clip_text,
    valid_partition, text_windows, sample_rows, bag_union, token_sets, keyed_intersection, kv_range_scans, kv_upsert, kv_put_new, kv_delete, pruned_scan, sampled_then_filtered, log_spaced_targets,
)}

ORACLE_SQL = {
    "route_split": """
select case when event_type in ('click', 'view') then 'browse' when event_type = 'purchase' then 'sale' else 'fault' end as port, event_id, user_id
from events where event_type in ('click', 'view', 'purchase', 'error')""",
    "dedup_first": """
select user_id, event_type, event_id, round(value, 6) as value
from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1""",
    "distinct_pairs": "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem",
    "topk_per_group": """
select o_custkey, o_orderkey, o_totalprice, cast(n - 1 as integer) as rank
from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 3""",
    "global_top_m": "select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 20",
    "priority_sort": """
with r as (select o_orderkey, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 99 end as rank, coalesce(o_totalprice, 0) as p from orders)
select row_number() over (order by rank, p desc, o_orderkey) - 1 as pos, o_orderkey, rank from r order by rank, p desc, o_orderkey limit 50""",
    "min_median_max": """
select o_orderpriority, s[1].k as least, s[len(s) // 2 + 1].k as middle, s[len(s)].k as greatest
from (select o_orderpriority, list({'p': o_totalprice, 'k': o_orderkey} order by o_totalprice, o_orderkey) as s from orders group by 1)""",
    "closest_to_mean": """
with c as (select c_nationkey, c_custkey, cast(cast(c_acctbal as decimal(18,2)) as double) as b from customer),
     m as (select c_nationkey, cast(sum(cast(round(b * 100) as bigint)) as double) / count(*) / 100 as mb, cast(sum(c_custkey) as double) / count(*) as mk from c group by 1),
     r as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by round(abs(b - mb) - abs(c_custkey - mk), 4), c_custkey) as n from c join m using (c_nationkey))
select c_nationkey, c_custkey, cast(n - 1 as integer) as rank from r where n <= 5""",
    "take_last": """
select user_id, array_to_string(a[greatest(len(a) - 4, 1) : len(a)], ',') as last from (select user_id, list(event_id order by event_id) as a from events group by 1)""",
    "cross_terms": """
with o as (select date_trunc('month', o_orderdate) as month, o_orderpriority as term from orders),
     m as (select unnest(generate_series(lo, hi, interval 1 month)) as month from (select min(month) as lo, max(month) as hi from o)),
     g as (select term, month from (select distinct term from o), m)
select term, strftime(month, '%Y-%m') as month, count(o.term) as n from g left join o using (term, month) group by all""",
    "explode_ranked": """
select p_partkey, cast(unnest(range(len(w))) as integer) as rank, unnest(w) as word from (select p_partkey, string_split(p_name, ' ') as w from part)""",
    "clip_text": "select doc_id, case when length(text) > 40 then substr(text, 1, 40) || '…' else text end as clipped from documents",
    "valid_partition": """
with r as (select l_orderkey, case when p_partkey is null then 'unknown part' when round(l_discount, 2) > 0.07 then 'discount' end as reason
           from lineitem left join (select p_partkey from part where p_size <= 40) on l_partkey = p_partkey)
select case when reason is null then 'valid' else 'rejected' end as side, reason, count(*) as n, cast(sum(l_orderkey) as bigint) as keys from r group by all""",
    "text_windows": """
with t as (select conv_id, turn, turn // 2 as own, max(turn // 2) over (partition by conv_id) as last from conversations),
     c as (select *, unnest(range(own, (turn + 1) // 2 + 1)) as chunk from t)
select conv_id, chunk, turn, chunk = own as is_focus from c where chunk <= last""",
    "sample_rows": "select doc_id, source from documents order by md5(concat_ws('|', '42', cast(doc_id as varchar))), doc_id limit 25",
    "bag_union": """
select nation, count(*) as n, cast(sum(cast(round(balance * 100) as bigint)) as bigint) as cents
from (select s_nationkey as nation, s_acctbal as balance from supplier union all select c_nationkey, c_acctbal from customer) group by 1""",
    "token_sets": """
with p as (select p_partkey, string_split(lower(p_name), ' ') as w from part),
     q as (select a.p_partkey, len(list_distinct(list_concat(a.w, b.w))) as either, len(list_distinct(list_intersect(a.w, b.w))) as shared from p a join p b on b.p_partkey = a.p_partkey + 1)
select p_partkey, cast(either as integer) as either, cast(shared as integer) as shared, round(coalesce(shared / nullif(either, 0), 0), 6) as jaccard from q""",
    "keyed_intersection": "select c_custkey as key from customer where c_custkey in (select user_id from events)",
    "kv_range_scans": """
with s(spec, lo, hi) as (values ('all', '', '~'), ('at_least', 'Customer#000000700', '~'), ('at_most', '', 'Customer#000000700'), ('greater_than', 'Customer#000000700' || chr(1), '~'),
                         ('closed', 'Customer#000000100', 'Customer#000000200'), ('open_closed', 'Customer#000000100' || chr(1), 'Customer#000000200'),
                         ('prefix', 'Customer#0000003', 'Customer#0000003~')),
     e(spec, lo, hi) as (values ('less_than', '', 'Customer#000000700'), ('closed_open', 'Customer#000000100', 'Customer#000000200'), ('open', 'Customer#000000100' || chr(1), 'Customer#000000200'))
select spec, count(*) as n, min(c_name) as first, max(c_name) as last from customer, s where c_name >= lo and c_name <= hi group by 1
union all
select spec, count(*), min(c_name), max(c_name) from customer, e where c_name >= lo and c_name < hi group by 1""",
    "kv_upsert": """
with n as (select c_custkey as key, c_name as value from customer)
select * from n union all select s_suppkey, s_name from supplier where s_suppkey not in (select key from n)""",
    "kv_put_new": "select s_suppkey as key, s_name as value from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)",
    "kv_delete": "select c_custkey as key, c_name as value from customer where c_custkey not in (select o_custkey from orders)",
    "pruned_scan": "select l_orderkey, l_quantity from lineitem where l_quantity >= 49",
    "sampled_then_filtered": """
with f as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as n from events),
     p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from f where n <= 40 and event_type = 'purchase')
select user_id, event_id, cast(k - 1 as integer) as rank from p where k <= 10""",
    "log_spaced_targets": """
with n as (select c_nationkey, count(*) as most from customer group by 1),
     t as (select c_nationkey, least(cast(pow(2, k + 3) as bigint), most) as target, min(k) as k from n, range(21) r(k) group by 1, 2)
select c_nationkey, string_agg(target, ',' order by k) as targets from t group by 1""",
}
