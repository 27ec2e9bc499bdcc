"""Event-rate alarm: tumbling windows with a summary of each and an alarm row for the busy ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmill.functions.times import seconds
from rillmill.sources.tables import events

SIZE_S, THRESHOLD = 3600, 16


def alarm_windows(spark, sf_dir):
    """One row ``window`` for each hour with events, and a row ``alarm`` beside it where there are more than THRESHOLD."""
    w = (F.floor(seconds("ts") / SIZE_S) * SIZE_S).cast("bigint")
    per_user = (
        events(spark, sf_dir)
        .select(w.alias("start_s"), "user_id", "value")
        .groupBy("start_s", "user_id")
        .agg(F.count("*").alias("c"), F.sum("value").alias("v"), F.count("value").alias("nv"))
    )
    per_window = per_user.groupBy("start_s").agg(
        F.sum("c").alias("n"),
        F.round(F.sum("v") / F.sum("nv"), 6).alias("mean_value"),
        F.max_by("user_id", F.struct(F.col("c"), -F.col("user_id"))).alias("top_user"),
    )
    kinds = F.array_compact(F.array(F.lit("window"), F.when(F.col("n") > THRESHOLD, F.lit("alarm"))))
    return per_window.select(F.explode(kinds).alias("kind"), "start_s", "n", "mean_value", "top_user")


QUERIES = {"alarm_windows": alarm_windows}

ORACLE_SQL = {
    "alarm_windows": f"""
with u as (select cast(floor(epoch_us(ts) / {SIZE_S * 1_000_000}.0) as bigint) * {SIZE_S} as start_s, user_id,
                  count(*) as c, sum(value) as v, count(value) as nv
           from events group by 1, 2),
     w as (select start_s, cast(sum(c) as bigint) as n, round(sum(v) / sum(nv), 6) as mean_value,
                  arg_max(user_id, (c, -user_id)) as top_user
           from u group by 1)
select 'window' as kind, start_s, n, mean_value, top_user from w
union all
select 'alarm', start_s, n, mean_value, top_user from w where n > {THRESHOLD}
""",
}
