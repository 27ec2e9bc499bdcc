"""Keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def join_by_key(ports: dict[str, DataFrame], require_all: bool = False) -> DataFrame:
    """One row for each key with an array of items for each port.

    Every port has columns key, seq and item; items keep the order of seq. A
    key on any side has a row (missing sides are empty), or with
    ``require_all`` only keys on all sides. Null is a key. The ports are tagged and
    grouped together, so that N ways cost one shuffle of partial lists.
    """
    tagged = None
    for name, df in ports.items():
        part = df.select("key", F.lit(name).alias("_port"), F.struct(F.col("seq"), F.col("item")).alias("_x"))
        tagged = part if tagged is None else tagged.unionByName(part)
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_port") == p, F.col("_x")))), lambda x: x["item"]).alias(p) for p in ports]
    out = tagged.groupBy("key").agg(*lists)
    if require_all:
        for p in ports:
            out = out.where(F.size(p) > 0)
    return out


def pairs(df: DataFrame, keys: list[str], order: list[Column], apart: Column) -> DataFrame:
    """Unordered pairs of rows with equal keys, as structs a and b (a before b), for which ``apart``, over a and b, isn't false; each pair once."""
    row = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    a = row.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct("*").alias("a"))
    b = row.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct("*").alias("b"))
    same = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    joined = a.join(b, [*same, F.col("a._n") < F.col("b._n")])
    return joined.where(F.coalesce(apart, F.lit(True))).select("a", "b")


def with_parent(df: DataFrame, id_: list[str], parent: list[str], columns: list[str]) -> DataFrame:
    """Each row with its parent's columns as parent_<name>, null where it has none."""
    up = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(id_)], *[F.col(c).alias(f"parent_{c}") for c in columns])
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(parent)]
    return df.join(up, on, "left").drop(*[f"_p{i}" for i in range(len(id_))])


def merge_adjacent(bins: DataFrame, merge, key: str = "pos") -> DataFrame:
    """Tournament merge: bins 2k and 2k+1 become bin k until one is left; an odd last bin is carried.

    ``merge`` gives the aggregate columns for a group of one or two bins; the number
    of rounds is the logarithm of the number of bins.
    """
    n = bins.agg(F.max(key)).first()[0]
    while n:
        bins = bins.withColumn("_side", F.col(key) % 2).withColumn(key, F.floor(F.col(key) / 2)).groupBy(key).agg(*merge("_side"))
        n //= 2
    return bins
