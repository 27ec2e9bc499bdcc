"""Queries on joins, aggregates and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.functions.times import seconds
from rillmill.operators import aggregates as A
from rillmill.operators import joins as J
from rillmill.operators.timewin import tumbling_start
from rillmill.sources.tables import table

DAY = 86400


def _three_ports(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("c_name").alias("item"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("item"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("item"))
    return {"names": c, "orders": o, "events": e}


def _joined(df):
    return df.select("key", F.array_join("names", ",").alias("names"), F.size("orders").alias("n_orders"), F.array_join("orders", ",").alias("orders"), F.size("events").alias("n_events"), F.array_join("events", ",").alias("events"))


def join_by_key_full(spark, sf_dir):
    return _joined(J.join_by_key(_three_ports(spark, sf_dir)))


def join_by_key_all(spark, sf_dir):
    return _joined(J.join_by_key(_three_ports(spark, sf_dir), require_all=True))


def compose_window_join(spark, sf_dir):
    """Sign-ups with the number of other events of the same user and day; days without sign-up have a null id."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", tumbling_start(seconds("ts"), DAY).alias("start"))
    signups = e.where("event_type = 'signup'").select("user_id", "start", "id")
    others = e.where("event_type in ('click', 'view')").groupBy("user_id", "start").agg(F.count("*").alias("n"))
    out = signups.join(others, ["user_id", "start"], "full")
    return out.select("user_id", "start", "id", F.coalesce("n", F.lit(0)).alias("n"))


def pairs_gap(spark, sf_dir):
    """Pairs of orders of one customer and priority at least 90 days apart."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", seconds("o_orderdate").alias("t"))
    p = J.pairs(o, ["o_custkey", "o_orderpriority"], [F.col("t"), F.col("o_orderkey")], F.abs(F.col("b.t") - F.col("a.t")) >= 90 * DAY)
    return p.select(F.col("a.o_custkey").alias("o_custkey"), F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"), (F.col("b.t") - F.col("a.t")).alias("gap"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("up"), "role", "text")


def parent_lookup(spark, sf_dir):
    t = J.with_parent(_turns(spark, sf_dir), ["conv_id", "turn"], ["conv_id", "up"], ["role", "text"])
    return t.select("conv_id", "turn", F.coalesce("parent_role", F.lit("")).alias("parent_role"), F.length(F.coalesce("parent_text", F.lit(""))).alias("parent_chars"))


def reply_edges(spark, sf_dir):
    """Edges from a turn to the next, but those from the first turn of a conversation."""
    t = _turns(spark, sf_dir)
    p = t.where("turn > 0").select("conv_id", F.col("turn").alias("up"), F.col("role").alias("parent_role"))
    return t.join(p, ["conv_id", "up"]).select("conv_id", F.col("up").alias("parent"), F.col("turn").alias("child"), "parent_role", F.col("role").alias("child_role"))


def semi_and_anti(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    has, hasnt = d.join(lab, "doc_id", "left_semi"), d.join(lab, "doc_id", "left_anti")
    both = has.withColumn("side", F.lit("in")).unionByName(hasnt.withColumn("side", F.lit("out")))
    return both.groupBy("side", "lang").agg(F.count("*").alias("n"))


def side_input_lookup(spark, sf_dir):
    """Customers by nation and region names; the planner broadcasts the dimensions, whose size it knows."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents"))


def pairwise_merge(spark, sf_dir):
    """Parts' names by brand merged as in a tournament: least id and longest name."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("id"), F.max(F.struct(F.length("p_name").alias("l"), (-F.col("p_partkey")).alias("k"), F.col("p_name").alias("v"))).alias("best"), F.count("*").alias("n"))
    p = p.withColumn("pos", F.row_number().over(Window.orderBy("p_brand")) - 1)  # a few dozen brands
    out = J.merge_adjacent(p.select("pos", "id", "best", "n"), lambda side: [F.min("id").alias("id"), F.max("best").alias("best"), F.sum("n").alias("n")])
    return out.select("id", F.col("best.v").alias("canonical"), "n")


def batch_by_group(spark, sf_dir):
    """Events by type, null for odd users' errors: count, first and last id, mean."""
    key = F.when((F.col("event_type") != "error") | (F.col("user_id") % 2 == 0), F.col("event_type"))
    g = table(spark, sf_dir, "events").groupBy(key.alias("key"))
    return g.agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.avg("value"), 6).alias("mean"))


def cumulative_by_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 1000).cast("bigint").alias("v"))
    out = A.cumulative(e, ["user_id"], [F.col("event_id")], n=F.count("*"), total=F.sum("v"), top=F.max("v"))
    return out.select("event_id", "user_id", "n", "total", "top")


def last_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x"), F.count("*").alias("n"))
    return e.select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"), "n")


def global_aggregate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.agg(
        F.count("*").alias("n"), F.min(cents).alias("least"), F.max(cents).alias("most"), F.sum(cents).alias("total"),
        F.round(F.count_if(F.col("l_returnflag") == "R") / F.nullif(F.count("*"), F.lit(0)), 6).alias("returned"),
    )


def frequencies_zero_filled(spark, sf_dir):
    """Events of each type for every customer as a user; most have none of some types."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return A.frequencies(e, ["user_id"], "event_type", e.select("event_type"), users)


def population_stdev(spark, sf_dir):
    """Both conventions for a group without values: null, and 0."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left")
    x = F.when(F.col("toxic") == 1, F.col("n_chars").cast("double"))
    return d.groupBy("source", "lang").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("sd"), F.round(F.coalesce(F.avg(x), F.lit(0.0)), 4).alias("mean0"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 4).alias("sd0"))


def class_gap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    of = lambda q: F.avg(F.when(F.col("quality") == q, F.col("n_chars")))
    return d.groupBy("lang").agg(F.round(of(1) - of(0), 4).alias("gap"))


def entity_rollup(spark, sf_dir):
    """Every part brand with its returned items in order of date; brands without any have none."""
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_orderkey", "l_linenumber")
    records = li.join(brands, "p_partkey").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_orderkey", "l_linenumber"))).alias("r"))
    out = brands.select("p_brand").distinct().join(records, "p_brand", "left")
    return out.select("p_brand", F.coalesce(F.array_join(F.col("r.l_orderkey").cast("array<string>"), ","), F.lit("")).alias("records"))


def nearest_rank_percentiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "n_chars")
    return A.nearest_ranks(d, ["source"], "n_chars", {f"p{round(p * 100)}": p for p in (0.0, 0.5, 0.95, 1.0)})


def _cents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("v"))


def h2_histogram(spark, sf_dir):
    return A.histogram(_cents(spark, sf_dir), ["l_returnflag"], "v", 2, 4)


def h2_dense_histogram(spark, sf_dir):
    """Clamped to 5,000,000, with values shifted so that some are negative."""
    return A.histogram(_cents(spark, sf_dir).withColumn("v", F.col("v") - 1_000_000), ["l_returnflag"], "v", 2, 4, top=5_000_000)


def h2_merge(spark, sf_dir):
    """Histograms of each line number, merged by flag."""
    parts = A.histogram(_cents(spark, sf_dir), ["l_returnflag", "l_linenumber"], "v", 2, 4)
    return parts.groupBy("l_returnflag", "bin").agg(F.sum("n").alias("n"))


def h2_percentiles(spark, sf_dir):
    h = A.histogram(_cents(spark, sf_dir), ["l_returnflag"], "v", 2, 4)
    return A.histogram_percentiles(h, ["l_returnflag"], [0.5, 0.9, 0.99, 0.999], 2, 4)


def h2_summary(spark, sf_dir):
    """Count, extremes, mean and deviation at the middles of the bins."""
    h = A.histogram(_cents(spark, sf_dir), ["l_returnflag"], "v", 2, 4)
    mid = A.h2_low(F.col("bin"), 2, 4) + A.h2_width(F.col("bin"), 2, 4) / 2.0
    h = h.withColumn("m", mid)
    mean = F.sum(F.col("m") * F.col("n")) / F.sum("n")
    var = F.sum(F.col("m") * F.col("m") * F.col("n")) / F.sum("n") - mean * mean
    return h.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.min(A.h2_low(F.col("bin"), 2, 4)).alias("low"), F.max(A.h2_low(F.col("bin"), 2, 4)).alias("high"), F.round(mean, 2).alias("mean"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 0).alias("sd"))


def pareto_parts(spark, sf_dir):
    """Parts that none beats on price (low), size (high) and key (low)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return A.skyline(p, {"p_retailprice": "min", "p_size": "max"}, "p_partkey")


def pareto_orders(spark, sf_dir):
    """Three dimensions: late, dear and with a small customer key; sorted frontiers are a plain sort of this."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", seconds("o_orderdate").alias("t"), "o_totalprice", "o_custkey")
    return A.skyline(o, {"t": "max", "o_totalprice": "max", "o_custkey": "min"}, "o_orderkey")


def xor_closure(spark, sf_dir):
    """Groups of events that are complete: the tokens of their members cancel out."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") / 4).cast("bigint").alias("grp"), "event_id", F.col("event_type"))
    parts = e.select("grp", F.col("event_id").alias("token")).unionByName(e.where("event_type <> 'error'").select("grp", F.col("event_id").alias("token")))
    return parts.groupBy("grp").agg(F.bit_xor("token").alias("x"), F.count("*").alias("n")).select("grp", "n", (F.col("x") == 0).alias("closed"))


QUERIES = {f.__name__: f for f in (
    join_by_key_full, join_by_key_all, compose_window_join, pairs_gap, parent_lookup, reply_edges, semi_and_anti, side_input_lookup, pairwise_merge, batch_by_group, cumulative_by_group, last_per_group,
    global_aggregate, frequencies_zero_filled, population_stdev, class_gap, entity_rollup, nearest_rank_percentiles, h2_histogram, h2_dense_histogram, h2_merge, h2_percentiles, h2_summary, pareto_parts, pareto_orders, xor_closure,
)}

_PORTS = """
with c as (select c_custkey as key, c_name as item from customer),
     o as (select o_custkey as key, list(o_orderpriority order by o_orderkey) as l from orders group by 1),
     e as (select user_id as key, list(event_type order by event_id) as l from events group by 1),
     k as (select key from c union select key from o union select key from e),
     j as (select k.key, coalesce(c.item, '') as names, cast(coalesce(len(o.l), 0) as integer) as n_orders, coalesce(array_to_string(o.l, ','), '') as orders,
                  cast(coalesce(len(e.l), 0) as integer) as n_events, coalesce(array_to_string(e.l, ','), '') as events
           from k left join c on c.key is not distinct from k.key left join o on o.key is not distinct from k.key left join e on e.key is not distinct from k.key)
select * from j"""
_BIN = lambda v: f"case when {v} < 128 then {v} >> 2 else ({v} >> (length(bin({v})) - 1 - 4)) + ((length(bin({v})) - 1 - 7 + 1) << 4) end"
_LOW = "case when bin < 32 then bin << 2 else (cast(1 as bigint) << cast(7 + ((bin - 32) >> 4) as integer)) + ((bin & 15) << cast(3 + ((bin - 32) >> 4) as integer)) end"
_WIDTH = "case when bin < 32 then 4 else cast(1 as bigint) << cast(3 + ((bin - 32) >> 4) as integer) end"
_HIST = f"""select l_returnflag, {_BIN('v')} as bin, count(*) as n from (select l_returnflag, cast(round(l_extendedprice * 100) as bigint) as v from lineitem) group by 1, 2"""

ORACLE_SQL = {
    "join_by_key_full": _PORTS,
    "join_by_key_all": _PORTS + " where names <> '' and n_orders > 0 and n_events > 0",
    "compose_window_join": f"""
with e as (select event_id as id, user_id, event_type, cast(floor(epoch_us(ts) / 1000000.0 / {DAY}) as bigint) * {DAY} as start from events),
     n as (select user_id, start, count(*) as n from e where event_type in ('click', 'view') group by all),
     s as (select user_id, start, id from e where event_type = 'signup')
select coalesce(s.user_id, n.user_id) as user_id, coalesce(s.start, n.start) as start, id, coalesce(n, 0) as n from s full join n on s.user_id = n.user_id and s.start = n.start""",
    "pairs_gap": f"""
with o as (select *, cast(floor(epoch_us(o_orderdate) / 1000000.0) as bigint) as t from orders)
select a.o_custkey, a.o_orderkey as a, b.o_orderkey as b, b.t - a.t as gap
from o a join o b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and (a.t, a.o_orderkey) < (b.t, b.o_orderkey) and b.t - a.t >= {90 * DAY}""",
    "parent_lookup": """
select c.conv_id, c.turn, coalesce(p.role, '') as parent_role, cast(length(coalesce(p.text, '')) as integer) as parent_chars
from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1""",
    "reply_edges": """
select c.conv_id, p.turn as parent, c.turn as child, p.role as parent_role, c.role as child_role
from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 where p.turn > 0""",
    "semi_and_anti": "select case when doc_id in (select doc_id from labels where quality = 1) then 'in' else 'out' end as side, lang, count(*) as n from documents group by all",
    "side_input_lookup": """
select r_name, n_name, count(*) as n, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as cents
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""",
    "pairwise_merge": "select min(p_partkey) as id, arg_max(p_name, (length(p_name), -p_partkey)) as canonical, count(*) as n from part",
    "batch_by_group": """
select case when event_type <> 'error' or user_id % 2 = 0 then event_type end as key, count(*) as n, min(event_id) as first, max(event_id) as last, round(avg(value), 6) as mean from events group by 1""",
    "cumulative_by_group": """
with e as (select event_id, user_id, cast(round(value * 1000) as bigint) as v from events)
select event_id, user_id, count(*) over w as n, cast(sum(v) over w as bigint) as total, max(v) over w as top from e window w as (partition by user_id order by event_id rows unbounded preceding)""",
    "last_per_group": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, count(*) as n from events group by 1",
    "global_aggregate": """
select count(*) as n, min(c) as least, max(c) as most, cast(sum(c) as bigint) as total, round(count(*) filter (l_returnflag = 'R') / count(*), 6) as returned
from (select l_returnflag, cast(round(l_extendedprice * 100) as bigint) as c from lineitem)""",
    "frequencies_zero_filled": """
with e as (select * from events)
select u.user_id, t.event_type, count(e.event_id) as n
from (select c_custkey as user_id from customer) u cross join (select distinct event_type from events) t left join e on e.user_id = u.user_id and e.event_type = t.event_type group by all""",
    "population_stdev": """
with d as (select source, lang, case when toxic = 1 then cast(n_chars as double) end as x from documents left join labels using (doc_id))
select source, lang, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as sd, round(coalesce(avg(x), 0), 4) as mean0, round(coalesce(stddev_pop(x), 0), 4) as sd0 from d group by all""",
    "class_gap": "select lang, round(avg(n_chars) filter (quality = 1) - avg(n_chars) filter (quality = 0), 4) as gap from documents join labels using (doc_id) group by 1",
    "entity_rollup": """
with r as (select p_brand, string_agg(l_orderkey, ',' order by l_shipdate, l_orderkey, l_linenumber) as records from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1)
select p_brand, coalesce(records, '') as records from (select distinct p_brand from part) left join r using (p_brand)""",
    "nearest_rank_percentiles": """
with s as (select source, list(n_chars order by n_chars) as s from documents group by 1)
select source, """ + ", ".join(f"s[least(len(s) - 1, cast(floor({p} * len(s)) as bigint)) + 1] as p{round(p * 100)}" for p in (0.0, 0.5, 0.95, 1.0)) + " from s",
    "h2_histogram": _HIST,
    "h2_dense_histogram": f"""
select l_returnflag, {_BIN('v')} as bin, count(*) as n
from (select l_returnflag, least(greatest(cast(round(l_extendedprice * 100) as bigint) - 1000000, 0), 5000000) as v from lineitem) group by 1, 2""",
    "h2_merge": _HIST,
    "h2_percentiles": f"""
with h as ({_HIST}),
     w as (select *, sum(n) over (partition by l_returnflag order by bin) as upto, sum(n) over (partition by l_returnflag) as total from h),
     r as (select *, greatest(1, ceil(p * total)) as rank from w, (values (0.5::double), (0.9::double), (0.99::double), (0.999::double)) t(p))
select l_returnflag, p, cast(trunc({_LOW} + (rank - (upto - n)) / n * {_WIDTH}) as bigint) as value from r where upto >= rank and upto - n < rank""",
    "h2_summary": f"""
with h as (select *, {_LOW} as low, {_LOW} + {_WIDTH} / 2.0 as m from ({_HIST}))
select l_returnflag, cast(sum(n) as bigint) as n, min(low) as low, max(low) as high, round(sum(m * n) / sum(n), 2) as mean, round(sqrt(sum(m * m * n) / sum(n) - pow(sum(m * n) / sum(n), 2)), 0) as sd from h group by 1""",
    "pareto_parts": """
select p_partkey, p_retailprice, p_size from part a where not exists (
  select 1 from part b where b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size or b.p_partkey < a.p_partkey))""",
    "pareto_orders": """
with o as (select o_orderkey, cast(floor(epoch_us(o_orderdate) / 1000000.0) as bigint) as t, o_totalprice, o_custkey from orders)
select * from o a where not exists (select 1 from o b where b.t >= a.t and b.o_totalprice >= a.o_totalprice and b.o_custkey <= a.o_custkey
  and (b.t > a.t or b.o_totalprice > a.o_totalprice or b.o_custkey < a.o_custkey or b.o_orderkey < a.o_orderkey))""",
    "xor_closure": """
with p as (select event_id // 4 as grp, event_id as token from events union all select event_id // 4, event_id from events where event_type <> 'error')
select grp, count(*) as n, bit_xor(token) = 0 as closed from p group by 1""",
}
