"""Projection, routing and selection operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def route(df: DataFrame, ports: dict[str, Column]) -> DataFrame:
    """Each row with the port it leaves by, the first whose condition holds; rows that fit none are dropped."""
    port = F.lit(None).cast("string")
    for name, condition in reversed(ports.items()):
        port = F.when(condition, F.lit(name)).otherwise(port)
    return df.withColumn("port", port).where("port is not null")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null is a key like others."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", row).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their 0-based rank; ``order`` must be total."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("rank", row).where(F.col("rank") < k)


def clip(text: Column, n: int) -> Column:
    """The first n characters, and an ellipsis if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def with_derived(df: DataFrame, condition: Column, kind: str, derived: str) -> DataFrame:
    """Each row as ``kind``, and again as ``derived`` where the condition holds."""
    kinds = F.array_compact(F.array(F.lit(kind), F.when(condition, F.lit(derived))))
    return df.withColumn("kind", F.explode(kinds))


def in_chunks(df: DataFrame, index: str, keys: list[str], focus: int, context: int) -> DataFrame:
    """Rows as focus of their chunk of ``focus`` rows, and as context of the next chunks whose ``context`` rows before the start they are among."""
    first = F.floor(F.col(index) / focus)
    last = F.floor((F.col(index) + context) / focus)
    size = F.max(F.floor(F.col(index) / focus)).over(Window.partitionBy(*keys))
    out = df.withColumn("_last", size).withColumn("chunk", F.explode(F.sequence(first, last))).where("chunk <= _last").drop("_last")
    return out.withColumn("is_focus", F.col("chunk") == first)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same ones on every run."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")
