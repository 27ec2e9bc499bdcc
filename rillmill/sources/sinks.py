"""Sinks: runs as JSON, a trace store of four tables, snapshots, and figures observed on the side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_json_run(df: DataFrame, base: str, run: str) -> str:
    """The rows as JSON lines in a folder of this run, which mustn't be there yet; gives the folder."""
    at = f"{base}/run={run}"
    df.write.mode("errorifexists").json(at)
    return at


def trace_tables(events: DataFrame) -> dict[str, DataFrame]:
    """runs, spans, events and payloads of trace events (run_id, msg_id, step, kind, t, seq, payload); a payload is stored once, under the hash of its content."""
    keyed = events.withColumn("payload_id", F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)))
    closing = F.col("kind").isin("success", "failure")
    spans = events.groupBy("run_id", "msg_id").agg(F.min(F.when(F.col("kind") == "recv", F.struct("seq", "t", "step"))).alias("_o"), F.min(F.when(closing, F.struct("seq", "t", "kind"))).alias("_c")).where("_o is not null")
    status = F.when(F.col("_c").isNull(), "open").when(F.col("_c.kind") == "success", "ok").otherwise("failed")
    return {
        "runs": events.groupBy("run_id").agg(F.min("t").alias("began"), F.max("t").alias("ended"), F.count("*").alias("events")),
        "spans": spans.select("run_id", "msg_id", F.col("_o.step").alias("step"), F.col("_o.t").alias("began"), F.col("_c.t").alias("ended"), status.alias("status")),
        "events": keyed.select("run_id", "msg_id", "step", "kind", "t", "seq", "payload_id"),
        "payloads": keyed.where("payload_id is not null").groupBy("payload_id").agg(F.first("payload").alias("payload")),
    }


def store_trace(events: DataFrame, base: str) -> None:
    """Write the four tables below base, by run where they have one. Payloads that base has already aren't written again."""
    spark = events.sparkSession
    for name, df in trace_tables(events).items():
        at = f"{base}/{name}"
        if name == "payloads":
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                df = df.join(spark.read.parquet(at).select("payload_id"), "payload_id", "left_anti")
            df.write.mode("append").parquet(at)
        else:
            df.write.mode("append").partitionBy("run_id").parquet(at)


def snapshot(spans: DataFrame) -> DataFrame:
    """Live figures of a trace by step: receipts, what is still open, failures, and latency."""
    took = F.col("ended") - F.col("began")
    of = lambda s: F.count_if(F.col("status") == s)
    return spans.groupBy("step").agg(F.count("*").alias("received"), of("open").alias("in_flight"), of("failed").alias("failed"), F.max(took).alias("slowest"), F.round(F.avg(took), 6).alias("mean"))


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """df as it is, and an observation that has the figures once an action on it has run."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in figures.items())), seen
