"""Smooth curves through points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _blend(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """Uniform Catmull-Rom blend of four control values."""
    return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)


def polyline(points: DataFrame, keys: list[str], x: str, y: str, pieces: int) -> DataFrame:
    """(keys, segment, k, px, py): ``pieces`` + 1 points on the curve between each two neighbours in order of x; the end points stand for the missing ones beyond them."""
    by = Window.partitionBy(*keys).orderBy(x)
    ends = {}
    for c in (x, y):
        ends[c] = (F.coalesce(F.lag(c).over(by), F.col(c)), F.col(c), F.lead(c).over(by), F.coalesce(F.lead(c, 2).over(by), F.lead(c).over(by)))
    named = [p.alias(f"_{n}{k}") for n, c in (("x", x), ("y", y)) for k, p in enumerate(ends[c])]
    rows = points.select(*keys, (F.row_number().over(by) - 1).alias("segment"), *named).where("_x2 is not null")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(pieces)))).withColumn("_t", F.col("k") / F.lit(float(pieces)))
    blend = lambda n: _blend(*(F.col(f"_{n}{k}") for k in range(4)), F.col("_t"))
    return rows.select(*keys, "segment", "k", blend("x").alias("px"), blend("y").alias("py"))
