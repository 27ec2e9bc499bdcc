"""Queries on event-time windows, series and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.functions.times import seconds
from rillmill.operators import series as S
from rillmill.operators import timewin as T
from rillmill.sources.tables import table

HOUR, DAY = 3600, 86400


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("t"))


def _shuffled(spark, sf_dir):
    """Events in an arrival order that differs from the order of time."""
    return _events(spark, sf_dir).withColumn("arrival", (F.col("event_id") + (F.col("event_id") * 37) % 101) * 1_000_000 + F.col("event_id"))


def tumbling_events(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(T.tumbling_start(F.col("t"), 6 * HOUR).alias("start"), "event_type")
    return e.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("bigint")).alias("milli"))


def sliding_events(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("start", F.explode(T.sliding_starts(F.col("t"), 6 * HOUR, 2 * HOUR)))
    return e.groupBy("start").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def late_events(spark, sf_dir):
    """Windows of ten minutes from out-of-order arrivals, without the rows that came after their window had closed."""
    e = T.tumbling_with_late(_shuffled(spark, sf_dir), "t", "arrival", 600).where("not is_late")
    return e.groupBy("start").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def late_side_output(spark, sf_dir):
    e = T.tumbling_with_late(_shuffled(spark, sf_dir), "t", "arrival", 600)
    return e.where("is_late").select("event_id", "start")


def late_sliding(spark, sf_dir):
    e = T.sliding_with_late(_shuffled(spark, sf_dir), "t", "arrival", 1200, 600)
    return e.select("event_id", "is_late", F.size("starts").alias("open"))


def bucket_assign(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", T.tumbling_start(F.col("t"), DAY).alias("day"), F.floor(F.col("t") % DAY / HOUR).alias("hour"))


def burst_stats(spark, sf_dir):
    """Gaps between a user's events: mean, deviation, variation, the middle gap and the median, the most events in five minutes against what an even rate gives."""
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = _events(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(by)).withColumn("near", F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(0, 300)))
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("t", "event_id", "gap")))), lambda x: x["gap"])
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), gaps.alias("g"), F.max("near").alias("peak"), (F.max("t") - F.min("t")).alias("span")).where("n >= 3")
    half = (F.floor(F.size("g") / 2) + 1).cast("int")
    return g.select(
        "user_id", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.when(F.col("mean") > 0, F.round(F.col("sd") / F.col("mean"), 6)).alias("cv"),
        F.element_at("g", half).alias("mid_gap"), F.element_at(F.array_sort("g"), half).alias("median_gap"), "peak",
        F.when(F.col("span") > 0, F.round(F.col("peak") / (300 * F.col("n") / F.col("span")), 6)).alias("peak_vs_even"),
    )


def tempo_24h(spark, sf_dir):
    """Share of a user's events in the busiest six hours of the day, around midnight too, and when these begin."""
    h = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") % DAY / HOUR).alias("h")).agg(F.count("*").alias("c"))
    starts = h.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.pmod(F.col("h") - k, F.lit(24)))))
    six = starts.groupBy("user_id", "start").agg(F.sum("c").alias("c"))
    best = six.groupBy("user_id").agg(F.max(F.struct(F.col("c"), -F.col("start"))).alias("b"))
    total = h.groupBy("user_id").agg(F.sum("c").alias("n"))
    return best.join(total, "user_id").select("user_id", "n", F.round(F.col("b.c") / F.col("n"), 6).alias("share"), (-F.col("b.col2")).alias("start"))


def month_spine(spark, sf_dir):
    """Orders by priority and month, zeros from each priority's first to last month."""
    m = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month")
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", m).agg(F.count("*").alias("n"))
    return S.zero_filled(o, ["o_orderpriority"], "month", "n")


def _popular(spark, sf_dir):
    """Quarterly sales of each part, zeros included; parts sell seldom enough for the series to differ."""
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("quarter")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", q)
    n = li.groupBy("l_partkey", "quarter").agg(F.count("*").alias("n"))
    ends = n.agg(F.min("quarter").alias("lo"), F.max("quarter").alias("hi"))  # one row
    grid = n.select("l_partkey").distinct().crossJoin(F.broadcast(ends)).select("l_partkey", F.explode(F.sequence("lo", "hi")).alias("quarter"))
    return S.as_arrays(grid.join(n, ["l_partkey", "quarter"], "left").select("l_partkey", "quarter", F.coalesce("n", F.lit(0)).alias("n")), ["l_partkey"], "quarter", "n")


def trajectory_terms(spark, sf_dir):
    s = F.col("series")
    return _popular(spark, sf_dir).select("l_partkey", F.array_max(s).alias("peak"), F.element_at(s, -1).alias("cur"), S.peak_gap(s).alias("gap"), S.popularity(s).alias("trajectory"))


def graveyard_topics(spark, sf_dir):
    """Users' topics by quarter of a day count: events of each type by five-day periods over the user's own range."""
    e = _events(spark, sf_dir).select("user_id", F.col("event_type").alias("topic"), F.floor(F.col("t") / (5 * DAY)).alias("q"))
    n = e.groupBy("user_id", "topic", "q").agg(F.count("*").alias("n"))
    spine = e.groupBy("user_id").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("q"))
    grid = e.select("user_id", "topic").distinct().join(spine, "user_id")
    a = S.as_arrays(grid.join(n, ["user_id", "topic", "q"], "left").select("user_id", "topic", "q", F.coalesce("n", F.lit(0)).alias("n")), ["user_id", "topic"], "q", "n")
    s = F.col("series")
    return a.select("user_id", "topic", F.array_max(s).alias("peak"), F.element_at("labels", F.array_position(s, F.array_max(s)).cast("int")).alias("peak_q"), S.trailing_zeros(s).alias("silent"), S.interest(s, 5, 3).alias("kind"))


def crank_z(spark, sf_dir):
    """Mean value of a user's event types against the user's own mean and deviation; types with five events or more."""
    e = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    u = e.groupBy("user_id").agg((F.sum("s") / F.sum("n")).alias("mu"), F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2), F.lit(0.0))).alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("s") / F.col("n") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return e.where("n >= 5").join(u, "user_id").select("user_id", "event_type", "n", F.round(z, 5).alias("z"))


def intensity_samples(spark, sf_dir):
    """The three strongest events of each user and type."""
    e = _events(spark, sf_dir)
    row = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))
    return e.withColumn("k", row).where("k <= 3").select("user_id", "event_type", "event_id", "k")


def voice_drift(spark, sf_dir):
    """Drift of users' habits between consecutive weeks."""
    w = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / (7 * DAY)).alias("week")).agg(
        F.count("*").cast("double").alias("n"), F.avg("value").alias("v"), F.avg((F.col("event_type") == "click").cast("double")).alias("clicks"), F.avg(F.col("t") % DAY / HOUR).alias("hour")
    )
    d = S.drift(w, ["user_id"], "week", ["n", "v", "clicks", "hour"])
    return d.select("user_id", "previous", "week", F.round("distance", 5).alias("distance"))


def date_buckets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    month, q = F.date_format("o_orderdate", "yyyy-MM"), F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate"))
    return o.groupBy(month.alias("month"), q.alias("quarter"), F.hour("o_orderdate").alias("hour")).agg(F.count("*").alias("n"))


def stats_merge(spark, sf_dir):
    """Counters of users' days merged by week."""
    e = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / DAY).alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("t").alias("last"))
    return e.groupBy(F.floor(F.col("d") / 7).alias("week")).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.max("last").alias("last"))


def quadrants(spark, sf_dir):
    """Users by means of value and of hour, 0 to 10 each: which side of 5 they are on."""
    e = _events(spark, sf_dir).groupBy("user_id").agg((F.avg(F.least(F.col("value"), F.lit(100.0))) / 10).alias("x"), (F.avg(F.col("t") % DAY / HOUR) / 2.4).alias("y"))
    q = F.when(F.col("x").isNull() | F.col("y").isNull(), None).otherwise(F.concat(F.when(F.col("x") >= 5, "high").otherwise("low"), F.lit("-"), F.when(F.col("y") >= 5, "late").otherwise("early")))
    return e.select("user_id", q.alias("quadrant"))


QUERIES = {f.__name__: f for f in (
    tumbling_events, sliding_events, late_events, late_side_output, late_sliding, bucket_assign, burst_stats, tempo_24h, month_spine, trajectory_terms, graveyard_topics, crank_z, intensity_samples, voice_drift, date_buckets, stats_merge, quadrants,
)}

_E = "e as (select event_id, user_id, event_type, value, cast(floor(epoch_us(ts) / 1000000.0) as bigint) as t from events)"
_LATE = f"""{_E}, a as (select *, (event_id + (event_id * 37) % 101) * 1000000 + event_id as arrival from e),
     w as (select *, max(t) over (order by arrival rows between unbounded preceding and 1 preceding) as wm from a)"""
_DRIFT_Z = lambda f: f"coalesce(({f} - avg({f}) over p) / nullif(stddev_pop({f}) over p, 0), 0)"

ORACLE_SQL = {
    "tumbling_events": f"with {_E} select t // {6 * HOUR} * {6 * HOUR} as start, event_type, count(*) as n, cast(sum(cast(round(value * 1000) as bigint)) as bigint) as milli from e group by all",
    "sliding_events": f"""
with {_E}, s as (select *, unnest(range(greatest((t - {6 * HOUR}) // {2 * HOUR} + 1, 0), t // {2 * HOUR} + 1)) * {2 * HOUR} as start from e)
select start, count(*) as n, count(distinct user_id) as users from s group by 1""",
    "late_events": f"with {_LATE} select t // 600 * 600 as start, count(*) as n, cast(sum(event_id) as bigint) as ids from w where not coalesce(t // 600 * 600 + 600 <= wm, false) group by 1",
    "late_side_output": f"with {_LATE} select event_id, t // 600 * 600 as start from w where t // 600 * 600 + 600 <= wm",
    "late_sliding": f"""
with {_LATE}, s as (select event_id, len([k for k in range((t - 1200) // 600 + 1, t // 600 + 1) if wm is null or k * 600 + 1200 > wm]) as open from w)
select event_id, open = 0 as is_late, cast(open as integer) as open from s""",
    "bucket_assign": f"with {_E} select event_id, t // {DAY} * {DAY} as day, t % {DAY} // {HOUR} as hour from e",
    "burst_stats": f"""
with {_E},
     g as (select *, t - lag(t) over (partition by user_id order by t, event_id) as gap, count(*) over (partition by user_id order by t range between current row and 300 following) as near from e),
     u as (select user_id, count(*) as n, avg(gap) as mean, stddev_pop(gap) as sd, list(gap order by t, event_id) filter (gap is not null) as g, max(near) as peak, max(t) - min(t) as span from g group by 1 having count(*) >= 3)
select user_id, n, round(mean, 4) as mean, round(sd, 4) as sd, case when mean > 0 then round(sd / mean, 6) end as cv, g[len(g) // 2 + 1] as mid_gap, list_sort(g)[len(g) // 2 + 1] as median_gap, peak,
       case when span > 0 then round(peak / (300 * n / span), 6) end as peak_vs_even from u""",
    "tempo_24h": f"""
with {_E}, h as (select user_id, t % {DAY} // {HOUR} as h, count(*) as c from e group by all),
     s as (select user_id, (h - k + 24) % 24 as start, cast(sum(c) as bigint) as c from h, range(6) r(k) group by all),
     n as (select user_id, cast(sum(c) as bigint) as n from h group by 1)
select user_id, any_value(n) as n, round(max(c) / any_value(n), 6) as share, arg_max(start, (c, -start)) as start from s join n using (user_id) group by 1""",
    "month_spine": """
with o as (select o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) - 1 as month, count(*) as n from orders group by all),
     s as (select o_orderpriority, cast(unnest(range(min(month), max(month) + 1)) as integer) as month from o group by 1)
select o_orderpriority, month, coalesce(n, 0) as n from s left join o using (o_orderpriority, month)""",
    "trajectory_terms": """
with li as (select l_partkey, cast(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 as bigint) as q from lineitem),
     m as (select unnest(range(min(q), max(q) + 1)) as q from li),
     g as (select b.l_partkey, m.q, count(li.q) as n from (select distinct l_partkey from li) b cross join m left join li on li.l_partkey = b.l_partkey and li.q = m.q group by all),
     s as (select l_partkey, list(n order by q) as s from g group by 1),
     f as (select l_partkey, list_max(s) as peak, s[len(s)] as cur, len(s) - list_max([i for i in range(1, len(s) + 1) if s[i] = list_max(s)]) as gap, case when len(s) > 6 then list_min(s[1 : len(s) - 6]) end as old from s)
select l_partkey, peak, cur, cast(gap as integer) as gap,
       case when peak = 0 then 'flat' when gap <= 6 and old < 0.2 * peak then 'rising' when gap >= 12 and cur <= 0.1 * peak then 'buried'
            when gap >= 6 and cur > 0.1 * peak and cur <= 0.5 * peak then 'fading' when gap <= 12 and cur > 0.5 * peak and cur <= 1.5 * peak then 'sustained' else 'fading' end as trajectory from f""",
    "graveyard_topics": f"""
with {_E}, x as (select user_id, event_type as topic, t // {5 * DAY} as q from e),
     sp as (select user_id, unnest(range(min(q), max(q) + 1)) as q from x group by 1),
     g as (select d.user_id, d.topic, sp.q, count(x.q) as n from (select distinct user_id, topic from x) d join sp on sp.user_id = d.user_id
           left join x on x.user_id = d.user_id and x.topic = d.topic and x.q = sp.q group by all),
     s as (select user_id, topic, list(n order by q) as s, list(q order by q) as l from g group by all),
     f as (select *, list_max(s) as peak, len(s) - list_max([case when s[i] > 0 then i else 0 end for i in range(1, len(s) + 1)]) as silent from s)
select user_id, topic, peak, l[list_position(s, peak)] as peak_q, cast(silent as integer) as silent,
       case when peak < 5 then 'ephemeral' when silent >= 3 then 'graveyard' when s[len(s)] < 0.25 * peak then 'fading' else 'active' end as kind from f""",
    "crank_z": f"""
with {_E}, g as (select user_id, event_type, count(*) as n, avg(value) as m from e group by all), u as (select user_id, avg(value) as mu, stddev_pop(value) as sd from e group by 1)
select user_id, event_type, n, round(case when sd > 0 then (m - mu) / sd else 0 end, 5) as z from g join u using (user_id) where n >= 5""",
    "intensity_samples": f"""
with {_E} select user_id, event_type, event_id, cast(k as integer) as k from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as k from e) where k <= 3""",
    "voice_drift": f"""
with {_E}, w as (select user_id, t // {7 * DAY} as week, cast(count(*) as double) as n, avg(value) as v, avg(case when event_type = 'click' then 1.0 else 0.0 end) as clicks, avg(t % {DAY} / {HOUR}) as hour from e group by all),
     z as (select user_id, week, [{', '.join(map(_DRIFT_Z, ('n', 'v', 'clicks', 'hour')))}] as z from w window p as (partition by user_id)),
     l as (select *, lag(z) over o as y, lag(week) over o as previous from z window o as (partition by user_id order by week)),
     d as (select *, sqrt(list_inner_product(z, z)) * sqrt(list_inner_product(y, y)) as norm from l where y is not null)
select user_id, previous, week, round(case when norm > 1e-12 then 1 - list_inner_product(z, y) / norm else 0 end, 5) as distance from d""",
    "date_buckets": "select strftime(o_orderdate, '%Y-%m') as month, year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter, cast(hour(o_orderdate) as integer) as hour, count(*) as n from orders group by all",
    "stats_merge": f"with {_E} select t // {DAY} // 7 as week, count(*) as n, count(*) filter (event_type = 'error') as failed, max(t) as last from e group by 1",
    "quadrants": f"""
with {_E}, u as (select user_id, avg(least(value, 100)) / 10 as x, avg(t % {DAY} / {HOUR}) / 2.4 as y from e group by 1)
select user_id, case when x is null or y is null then null else (case when x >= 5 then 'high' else 'low' end) || '-' || (case when y >= 5 then 'late' else 'early' end) end as quadrant from u""",
}
