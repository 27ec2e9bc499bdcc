"""The window operators on unbounded input.

``tumbling`` and ``sliding`` use Spark's own watermark, which moves between
micro-batches. ``exact_late`` moves it with every row, as the batch operator
does: state is one number for each key, kept by ``applyInPandasWithState``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream; ``files_per_batch`` limits the rate."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def tumbling(df: DataFrame, time_: str, size: str, keys: list[str], delay: str = "0 seconds", **aggs: Column) -> DataFrame:
    """One row for each window and key once the watermark has passed its end; windows without rows are never emitted."""
    w = F.window(time_, size)
    out = df.withWatermark(time_, delay).groupBy(w.alias("_w"), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *aggs)


def sliding(df: DataFrame, time_: str, size: str, slide: str, keys: list[str], delay: str = "0 seconds", **aggs: Column) -> DataFrame:
    w = F.window(time_, size, slide)
    out = df.withWatermark(time_, delay).groupBy(w.alias("_w"), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, *aggs)


def exact_late(df: DataFrame, key: str, t: str, seq: str, size: int) -> DataFrame:
    """(key, seq, t, start, is_late) for each row: late if its window of ``size`` had ended at the greatest t of an earlier row of its key.

    Rows of a micro-batch are taken in order of ``seq``. A watermark for each key scales with
    the keys; a constant key gives one for all, in one task.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(seq)
        start = rows[t] // size * size
        before = rows[t].cummax().shift(1)
        if mark is not None:
            before = before.fillna(mark).clip(lower=mark)
        state.update((int(max(rows[t].max(), mark if mark is not None else rows[t].max())),))
        yield pd.DataFrame({key: rows[key], seq: rows[seq], t: rows[t], "start": start, "is_late": (start + size <= before).fillna(False).astype(bool)})

    out = f"{key} {fields[key]}, {seq} {fields[seq]}, {t} {fields[t]}, start bigint, is_late boolean"
    return df.groupBy(key).applyInPandasWithState(run, out, "mark bigint", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what there is to Parquet, and end: exactly once, also if it is started again with the same checkpoint."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def attempt(call: Callable, value, retries: int = 3, base_ms: float = 0, most_ms: float = 1000, retry: Callable[[Exception], bool] = lambda e: True) -> dict:
    """{ok, value, error, attempts}: calls again with doubling waits; what fails for good is a dead letter, never an exception."""
    for n in range(1, retries + 2):
        try:
            return {"ok": True, "value": call(value), "error": None, "attempts": n}
        except Exception as e:  # noqa: BLE001
            if n > retries or not retry(e):
                return {"ok": False, "value": None, "error": f"{type(e).__name__}: {e}", "attempts": n}
            time.sleep(min(base_ms * 2 ** (n - 1), most_ms) / 1000)
    raise AssertionError


def scored(df: DataFrame, column: str, call: Callable, value_type: str, **params) -> DataFrame:
    """df and a struct ``result`` of ``attempt`` on a column; equal values are asked once, and joined back."""
    schema = f"_v {df.schema[column].dataType.simpleString()}, result struct<ok: boolean, value: {value_type}, error: string, attempts: int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_v": b["_v"], "result": [attempt(call, v, **params) for v in b["_v"]]})

    asked = df.select(F.col(column).alias("_v")).distinct().mapInPandas(run, schema)
    return df.join(asked, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")
