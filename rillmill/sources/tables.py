"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHARE = 150_000  # rows of a table that a partition of what is grouped by a fine key takes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df dealt out by keys into so many partitions, if these are more than Spark would make by itself: a task's share then doesn't grow with the data."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts > own else df


def file_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what df reads; 0 if it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else 0
