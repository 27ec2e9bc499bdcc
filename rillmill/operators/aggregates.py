"""Grouped, running and distribution aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative(df: DataFrame, keys: list[str], order: list[Column], **running) -> DataFrame:
    """Each row with aggregates over the rows of its key so far, itself included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: agg.over(w) for name, agg in running.items()})


def frequencies(df: DataFrame, keys: list[str], value: str, vocabulary: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Counts of each value of the vocabulary (one column named like value) for each key of the universe, or of df, zeros included; the vocabulary is one list beside each key."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    words = vocabulary.agg(F.collect_set(value).alias("_all"))
    grid = (df if universe is None else universe).select(*keys).distinct().crossJoin(words).select(*keys, F.explode("_all").alias(value))
    return grid.join(counts, [*keys, value], "left").select(*keys, value, F.coalesce("n", F.lit(0)).alias("n"))


RANGES = 4096


def at_ranks(df: DataFrame, keys: list[str], value: str, pick: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each key and name of ``places`` the ``pick`` of the row at that place (from 0, a function of the number of values) in order of value and pick; null values don't count.

    Values are counted by up to RANGES equal ranges between a key's least and greatest, so only rows of the ranges that hold a place are sorted:
    no group is gathered in a task, whatever its size.
    """
    same = lambda a, b, cols: [a[c].eqNullSafe(b[f"_{c}"]) for c in cols]
    prefixed = lambda x, cols: x.select(*(F.col(c).alias(f"_{c}" if c in cols else c) for c in x.columns))
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    whole = prefixed(ends, keys)
    rows = df.select(*keys, value, pick).where(F.col(value).isNotNull())
    rows = rows.join(whole, same(rows, whole, keys)).drop(*(f"_{k}" for k in keys))
    span = F.col("_hi").cast("double") - F.col("_lo")
    at = F.least(F.lit(RANGES - 1), F.floor((F.col(value).cast("double") - F.col("_lo")) / span * RANGES))
    rows = rows.withColumn("_at", F.when(span > 0, at).otherwise(0).cast("int"))
    counts = rows.groupBy(*keys, "_at").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = F.array(*(F.struct(F.lit(k).alias("name"), f(F.col("_n")).cast("bigint").alias("place")) for k, f in places.items()))
    wanted = counts.withColumn("_before", before).withColumn("_w", F.explode(names)).where((F.col("_w.place") >= F.col("_before")) & (F.col("_w.place") < F.col("_before") + F.col("_c")))
    wanted = prefixed(wanted.select(*keys, "_at", F.col("_w.name").alias("_name"), (F.col("_w.place") - F.col("_before")).alias("_place")), [*keys, "_at"])
    some = rows.drop("_n", "_lo", "_hi")
    some = some.join(wanted, same(some, wanted, [*keys, "_at"])).select(*keys, value, pick, "_name", "_place")
    order = Window.partitionBy(*keys, "_name").orderBy(value, pick)
    found = some.withColumn("_row", F.row_number().over(order) - 1).where("_row = _place").groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == k, F.col(pick))).alias(k) for k in places))
    found = prefixed(found, keys)
    return ends.join(found, same(ends, found, keys), "left").select(*keys, *places)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, floor(p n))] of each key's values for each p, null for none; not what percentile_disc gives."""
    return at_ranks(df.withColumn("_v", F.col(value)), keys, value, "_v", {k: (lambda n, p=p: F.least(n - 1, F.floor(F.lit(p) * n))) for k, p in ps.items()})


# H2 histograms: bins of width 2^a up to 2^(a+b+1), then 2^b bins for each power of two.


def h2_bin(v: Column, a: int, b: int) -> Column:
    """Bin of a non-negative bigint; the bit length is taken from the binary digits, as a double's logarithm is inexact beyond 2^53."""
    c = a + b + 1
    s = F.length(F.bin(v)) - 1
    shift = lambda x, n: F.call_function("shiftright", x, n)
    high = shift(v, (s - b).cast("int")) + F.shiftleft((s - c + 1).cast("bigint"), b)
    return F.when(v < (1 << c), F.shiftright(v, a)).otherwise(high)


def h2_low(i: Column, a: int, b: int) -> Column:
    """Lower edge of a bin."""
    c, first = a + b + 1, 1 << (b + 1)
    s = F.shiftright(i - first, b) + c
    high = F.call_function("shiftleft", F.lit(1).cast("bigint"), s.cast("int")) + F.call_function("shiftleft", i.bitwiseAND((1 << b) - 1), (s - b).cast("int"))
    return F.when(i < first, F.shiftleft(i, a)).otherwise(high)


def h2_width(i: Column, a: int, b: int) -> Column:
    c, first = a + b + 1, 1 << (b + 1)
    s = F.shiftright(i - first, b) + c
    return F.when(i < first, F.lit(1 << a).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), (s - b).cast("int")))


def histogram(df: DataFrame, keys: list[str], value: str, a: int, b: int, top: int | None = None) -> DataFrame:
    """(keys, bin, n): sparse, or with ``top`` dense, where negatives count as 0 and what is beyond as the last bin. Bin counts of parts add up, so partial aggregation merges histograms."""
    v = F.col(value).cast("bigint")
    if top is not None:
        v = F.least(F.greatest(v, F.lit(0)), F.lit(top))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, h2_bin(v, a, b).alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentiles(hist: DataFrame, keys: list[str], ps: list[float], a: int, b: int) -> DataFrame:
    """(keys, p, value): the value at rank max(1, ceil(p n)), interpolated linearly in its bin and cut to an integer."""
    by = Window.partitionBy(*keys).orderBy("bin")
    h = hist.withColumn("_upto", F.sum("n").over(by)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    h = h.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_all"))))
    h = h.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("n") < F.col("_rank")))
    inside = (F.col("_rank") - (F.col("_upto") - F.col("n"))) / F.col("n")
    return h.select(*keys, "p", (h2_low(F.col("bin"), a, b) + inside * h2_width(F.col("bin"), a, b)).cast("bigint").alias("value"))


def skyline(df: DataFrame, dims: dict[str, str], seq: str) -> DataFrame:
    """Rows that no other dominates; dims maps columns to min or max. Of equal coordinates the first by seq stays; rows with a null coordinate are left out.

    Each partition keeps its own skyline first, then groups of partitions, so only what is left of these meets in one place.
    """
    sign = np.array([1.0 if d == "max" else -1.0 for d in dims.values()])
    names = list(dims)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            rows = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
            x = rows[names].to_numpy(dtype=float) * sign
            order = np.lexsort((rows[seq].to_numpy(), *(-x[:, k] for k in range(x.shape[1] - 1, -1, -1))))
            kept: list[int] = []
            front = np.empty((len(x), x.shape[1]))
            for i in order:  # in this order nothing later dominates what is kept
                if not (front[: len(kept)] >= x[i]).all(axis=1).any():
                    front[len(kept)] = x[i]
                    kept.append(i)
            best = rows.iloc[kept]
        if best is not None:
            yield best

    some = df.dropna(subset=names)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = some.mapInPandas(local, df.schema)
    while parts > 1:
        parts = parts // 16
        out = out.repartition(max(1, parts)).mapInPandas(local, df.schema)
    return out


def merge_histograms(parts: list[tuple[DataFrame, tuple[int, int]]], keys: list[str]) -> DataFrame:
    """The bin-wise sum of histograms, each given with its (a, b); these must agree, as bins of others mean other values. Dense and sparse ones merge alike."""
    if len({p for _, p in parts}) != 1:
        raise ValueError("histograms of different parameters can't be merged")
    both = parts[0][0]
    for df, _ in parts[1:]:
        both = both.unionByName(df)
    return both.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
