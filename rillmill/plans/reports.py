"""Whole pipelines: several operators chained to one report."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.functions import text as X
from rillmill.functions.times import seconds
from rillmill.operators import aggregates as A
from rillmill.operators import joins as J
from rillmill.operators import route as R
from rillmill.operators import series as S
from rillmill.plans import text, windows
from rillmill.plans.windows import DAY
from rillmill.sources.tables import table

TYPES = ("click", "error", "purchase", "signup", "view")
STYLE = ("n_tokens", "sentence_mean", "word_mean", "hedge_rate", "assertion_rate", "first_person_rate", "number_rate", "question_rate")


def front_page(spark, sf_dir):
    """The 30 dearest orders, the first five items of each with their rank, and a score of the page's entry."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)
    ids = o.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    kids = R.top_per_group(ids.join(li, "o_orderkey").withColumnRenamed("rank", "story"), ["o_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], 5)
    g = kids.groupBy("story", "o_orderkey").agg(F.array_sort(F.collect_list(F.struct("rank", "l_partkey"))).alias("k"), F.sum("q").alias("score"))
    return g.select("story", "o_orderkey", F.array_join("k.l_partkey", ",").alias("kids"), "score")


def story_items(spark, sf_dir):
    """Every order with its items in their order, none for an order without any."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).cast("bigint").alias("seq"), F.col("o_orderpriority").alias("item"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).cast("bigint").alias("seq"), F.concat_ws(":", "l_linenumber", "l_partkey").alias("item"))
    out = J.join_by_key({"stories": o, "items": li}).where("size(stories) > 0")
    return out.select("key", F.array_join("stories", ",").alias("story"), F.size("items").alias("n"), F.array_join("items", ",").alias("items"))


def emotion_by_week(spark, sf_dir):
    """Events by week with a score of each: number, mean, deviation, counts of every type, and the least, middle and greatest of them."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor(seconds("ts") / (7 * DAY)).alias("week"), F.round(F.col("value") * 100).cast("bigint").alias("score"))
    g = e.groupBy("week").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_pop("score"), 3).alias("sd"), *(F.count_if(F.col("event_type") == t).alias(t) for t in TYPES)
    )
    places = {"least": lambda n: n * 0, "middle": lambda n: F.floor(n / 2), "greatest": lambda n: n - 1}
    return g.join(A.at_ranks(e, ["week"], "score", "event_id", places), "week", "left")


def crank_index(spark, sf_dir):
    """Each user's types by z-score, with the three strongest events as samples."""
    samples = windows.intensity_samples(spark, sf_dir).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("k", "event_id"))).alias("s"))
    return windows.crank_z(spark, sf_dir).join(samples, ["user_id", "event_type"]).select("user_id", "event_type", "n", "z", F.array_join("s.event_id", ",").alias("samples"))


def tempo_report(spark, sf_dir):
    """Bursts and the busiest hours of each user, gathered; users of fewer than three events have the latter only."""
    b = windows.burst_stats(spark, sf_dir).select("user_id", "cv", "peak", "peak_vs_even")
    t = windows.tempo_24h(spark, sf_dir).select("user_id", "n", "share", "start")
    return t.join(b, "user_id", "left")


def reply_posture(spark, sf_dir):
    """Replies by the roles of both sides and the sentiment of the reply, and the share of each posture among a pair of roles."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("up"), "role", "text")
    p = J.with_parent(t, ["conv_id", "turn"], ["conv_id", "up"], ["role"]).where("parent_role is not null")
    n = p.groupBy("parent_role", "role", X.sentiment(F.col("text")).alias("posture")).agg(F.count("*").alias("n"))
    whole = n.groupBy("parent_role", "role").agg(F.sum("n").alias("of"))
    return n.join(whole, ["parent_role", "role"]).select("parent_role", "role", "posture", "n", F.round(F.col("n") / F.col("of"), 6).alias("share"))


def title_report(spark, sf_dir):
    """How pages' titles relate to what the pages begin with: number and mean common share of each relation."""
    r = text.title_relations(spark, sf_dir)
    return r.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("common"), 5).alias("common"), F.min("page_id").alias("first"))


def voice_fingerprint(spark, sf_dir):
    """Drift of each source's style from one fifth of its documents to the next."""
    s = X.style_features(_fifths(spark, sf_dir), "text").groupBy("source", "fifth").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in STYLE))
    out = S.drift(s, ["source"], "fifth", list(STYLE))
    return out.select("source", "previous", "fifth", F.round("distance", 4).alias("distance"))


def _fifths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text").where("source is not null")
    last = d.agg((F.max("doc_id") + 1).alias("_end"))  # one row
    return d.crossJoin(F.broadcast(last)).select("source", F.floor(F.col("doc_id") * 5 / F.col("_end")).alias("fifth"), "text")


QUERIES = {f.__name__: f for f in (front_page, story_items, emotion_by_week, crank_index, tempo_report, reply_posture, title_report, voice_fingerprint)}

_W, _X = windows.ORACLE_SQL, text.ORACLE_SQL

ORACLE_SQL = {
    "front_page": """
with o as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as story from orders),
     k as (select story, o_orderkey, l_partkey, cast(l_quantity as bigint) as q, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey) as r from o join lineitem on l_orderkey = o_orderkey where story < 30)
select cast(story as integer) as story, o_orderkey, string_agg(l_partkey, ',' order by r) as kids, cast(sum(q) as bigint) as score from k where r <= 5 group by 1, 2""",
    "story_items": """
with l as (select l_orderkey as k, count(*) as n, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) as items from lineitem group by 1)
select o_orderkey as key, o_orderpriority as story, cast(coalesce(n, 0) as integer) as n, coalesce(items, '') as items from orders left join l on k = o_orderkey""",
    "emotion_by_week": f"""
with e as (select event_id, event_type, cast(floor(epoch_us(ts) / 1000000.0) as bigint) // {7 * DAY} as week, cast(round(value * 100) as bigint) as score from events),
     s as (select week, list(event_id order by score, event_id) filter (score is not null) as s from e group by 1),
     g as (select week, count(*) as n, round(avg(score), 4) as mean, round(stddev_pop(score), 3) as sd, {', '.join(f"count(*) filter (event_type = '{t}') as {t}" for t in TYPES)} from e group by 1)
select g.*, s[1] as least, s[len(s) // 2 + 1] as middle, s[len(s)] as greatest from g join s using (week)""",
    "crank_index": f"""
select z.user_id, z.event_type, z.n, z.z, samples from ({_W['crank_z']}) z
join (select user_id, event_type, string_agg(event_id, ',' order by k) as samples from ({_W['intensity_samples']}) group by all) s using (user_id, event_type)""",
    "tempo_report": f"select t.user_id, t.n, t.share, t.start, b.cv, b.peak, b.peak_vs_even from ({_W['tempo_24h']}) t left join ({_W['burst_stats']}) b using (user_id)",
    "reply_posture": f"""
with p as (select a.role as parent_role, b.role, {text._sentiment('b.text')} as posture from conversations b join conversations a on a.conv_id = b.conv_id and a.turn = b.turn - 1 where a.role is not null),
     n as (select parent_role, role, posture, count(*) as n from p group by all)
select *, round(n / sum(n) over (partition by parent_role, role), 6) as share from n""",
    "title_report": f"select relation, count(*) as n, round(avg(common), 5) as common, min(page_id) as first from ({_X['title_relations']}) group by 1",
    "voice_fingerprint": f"""
with f as ({_X['style_features']}), d as (select doc_id, source, cast(floor(doc_id * 5 / (select max(doc_id) + 1 from documents where source is not null)) as bigint) as fifth from documents where source is not null),
     s as (select source, fifth, {', '.join(f'avg(cast({c} as double)) as {c}' for c in STYLE)} from d join f using (doc_id) group by all),
     z as (select source, fifth, [{', '.join(map(windows._DRIFT_Z, STYLE))}] as z from s window p as (partition by source)),
     l as (select source, fifth, z, lag(z) over o as y, lag(fifth) over o as previous from z window o as (partition by source order by fifth)),
     n as (select *, sqrt(list_inner_product(z, z)) * sqrt(list_inner_product(y, y)) as norm from l where y is not null)
select source, previous, fifth, round(case when norm > 1e-12 then 1 - list_inner_product(z, y) / norm else 0 end, 4) as distance from n""",
}
