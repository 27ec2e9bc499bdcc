"""Event-time windows on integer times, with an exact watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling_start(t: Column, size: int) -> Column:
    return (F.floor(t / size) * size).cast("bigint")


def sliding_starts(t: Column, size: int, slide: int) -> Column:
    """Array of the starts k * slide >= 0 of the windows [start, start + size) that hold t; none may be left where slide > size."""
    last = F.floor(t / slide)
    first = F.greatest(F.floor((t - size) / slide) + 1, F.lit(0))
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: (k * slide).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def with_watermark(df: DataFrame, t: str, seq: str, rows: int = 1_000_000) -> DataFrame:
    """Each row with _wm, the greatest time of all rows before it in order of seq.

    Two levels, so that no task sees all rows: maxima of ranges of seq, of about ``rows`` rows each (and 64 ranges at least), are carried over to
    the ranges after them, and a running maximum is taken within each.
    """
    lo, hi, n = df.agg(F.min(seq), F.max(seq), F.count("*")).first()
    if lo is None:
        return df.withColumn("_wm", F.lit(None).cast("bigint"))
    width = max((hi - lo) // max(64, n // rows) + 1, 1)
    ranged = df.withColumn("_part", F.floor((F.col(seq) - lo) / width))
    tops = ranged.groupBy("_part").agg(F.max(t).alias("_top"))
    carried = F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col("_part").alias("_p"), carried.alias("_before"))  # a row for each range
    inside = F.max(t).over(Window.partitionBy("_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    out = ranged.withColumn("_in", inside).join(tops, F.col("_part") == F.col("_p"))
    return out.withColumn("_wm", F.greatest("_in", "_before")).drop("_part", "_p", "_in", "_before")


def tumbling_with_late(df: DataFrame, t: str, seq: str, size: int) -> DataFrame:
    """Rows with start and is_late: whether the window had closed, its end being at or before the watermark, when the row came."""
    start = tumbling_start(F.col(t), size)
    out = with_watermark(df, t, seq).withColumn("start", start)
    return out.withColumn("is_late", F.coalesce(F.col("start") + size <= F.col("_wm"), F.lit(False))).drop("_wm")


def sliding_with_late(df: DataFrame, t: str, seq: str, size: int, slide: int) -> DataFrame:
    """Rows with starts, the windows still open when the row came, and is_late if it had some and all were closed."""
    out = with_watermark(df, t, seq).withColumn("_all", sliding_starts(F.col(t), size, slide))
    live = F.filter("_all", lambda s: F.col("_wm").isNull() | (s + size > F.col("_wm")))
    return out.withColumn("starts", live).withColumn("is_late", (F.size("_all") > 0) & (F.size("starts") == 0)).drop("_wm", "_all")
