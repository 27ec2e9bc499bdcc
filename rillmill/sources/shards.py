"""Sharded folders, and a polled source as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def _with_shard(df: DataFrame) -> DataFrame:
    return df.withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def parquet_shards(spark: SparkSession, base: str, file: str, columns: list[str] | None = None) -> DataFrame:
    """The file of that name of every folder below base, with the folder's name as ``shard``; only the named columns are read."""
    df = _with_shard(spark.read.parquet(f"{base}/*/{file}"))
    return df.select(*columns, "shard") if columns else df


def json_shards(spark: SparkSession, base: str, file: str, schema: str) -> DataFrame:
    """As ``parquet_shards``, of JSON documents."""
    return _with_shard(spark.read.schema(schema).json(f"{base}/*/{file}", multiLine=True))


def polled(spark: SparkSession, name: str, schema: str, poll: Callable[[dict], tuple[list[tuple], dict]], start: dict) -> DataFrame:
    """A stream of what ``poll(state)`` gives, (rows, next state); the state is the offset, so a restart goes on where the last commit was.

    ``poll`` must give the same rows for the same state, as a batch may be read again.
    """

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return start

        def read(self, offset: dict):
            rows, after = poll(offset)
            return iter(rows), after

        def readBetweenOffsets(self, begin: dict, end: dict):
            rows: list[tuple] = []
            while begin != end:
                more, begin = poll(begin)
                rows += more
            return iter(rows)

    def called(cls) -> str:
        return name

    source = type("Polled", (DataSource,), {"name": classmethod(called), "schema": lambda self: schema, "simpleStreamReader": lambda self, schema: Reader()})
    spark.dataSource.register(source)
    return spark.readStream.format(name).load()
