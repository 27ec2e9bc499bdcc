"""Time series: spines, zero fill, trajectories, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def zero_filled(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Values for every index from a key's first to its last, 0 where it has none."""
    spine = df.groupBy(*keys).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi")).select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(index))
    return spine.join(df, [*keys, index], "left").select(*keys, index, F.coalesce(value, F.lit(0)).alias(value))


def as_arrays(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """One row a key with ``series``, its values in order of index."""
    s = F.array_sort(F.collect_list(F.struct(index, value)))
    return df.groupBy(*keys).agg(F.transform(s, lambda x: x[value]).alias("series"), F.transform(s, lambda x: x[index]).alias("labels"))


def peak_gap(series: Column) -> Column:
    """Places between the greatest value (the last of equals) and the end."""
    pos = F.array_max(F.transform(series, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))["i"]
    return F.size(series) - 1 - pos


def popularity(series: Column) -> Column:
    """flat, rising, buried, fading or sustained, by the peak's age and height against the first and last values."""
    peak, cur, gap = F.array_max(series), F.element_at(series, -1), peak_gap(series)
    old = F.when(F.size(series) > 6, F.array_min(F.slice(series, F.lit(1), F.greatest(F.size(series) - 6, F.lit(1)))))
    return (
        F.when((F.size(series) == 0) | (peak == 0), "flat")
        .when((gap <= 6) & (old < 0.2 * peak), "rising")
        .when((gap >= 12) & (cur <= 0.1 * peak), "buried")
        .when((gap >= 6) & (cur > 0.1 * peak) & (cur <= 0.5 * peak), "fading")
        .when((gap <= 12) & (cur > 0.5 * peak) & (cur <= 1.5 * peak), "sustained")
        .otherwise("fading")
    )


def trailing_zeros(series: Column) -> Column:
    last = F.array_max(F.transform(series, lambda v, i: F.when(v > 0, i + 1).otherwise(0)))
    return F.size(series) - last


def interest(series: Column, peak_min: int = 5, silent: int = 4) -> Column:
    """ephemeral, graveyard, fading or active."""
    peak, cur = F.array_max(series), F.element_at(series, -1)
    return F.when(peak < peak_min, "ephemeral").when(trailing_zeros(series) >= silent, "graveyard").when(cur < 0.25 * peak, "fading").otherwise("active")


def drift(df: DataFrame, keys: list[str], period: str, features: list[str]) -> DataFrame:
    """Cosine distance between a key's consecutive periods, each feature as z-score over the key's periods (0 where it doesn't vary; a zero vector has distance 0)."""
    by = Window.partitionBy(*keys)
    z = [F.coalesce(F.try_divide(F.col(f) - F.avg(f).over(by), F.stddev_pop(f).over(by)), F.lit(0.0)) for f in features]
    order = by.orderBy(period)
    v = df.withColumn("_z", F.array(*z)).withColumn("_y", F.lag("_z").over(order)).withColumn("previous", F.lag(period).over(order))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("_z", "_z")) * F.sqrt(dot("_y", "_y"))
    distance = F.when(norm > 1e-12, 1 - dot("_z", "_y") / norm).otherwise(0.0)
    return v.where("_y is not null").select(*keys, "previous", period, distance.alias("distance"))
