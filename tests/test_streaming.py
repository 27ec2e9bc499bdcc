"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from rillmill.operators import timewin
from rillmill.sources.shards import json_shards, parquet_shards, polled
from rillmill.streaming import windows as W

ROWS = [(1, 0, "a"), (2, 250, "a"), (3, 50, "a"), (4, 300, "a"), (5, 120, "b"), (6, 20, "b"), (7, 130, "b")]


def test_late_rows_in_several_batches(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "seq bigint, t bigint, k string")
    for i in range(0, len(ROWS), 2):
        spark.createDataFrame(ROWS[i : i + 2], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = W.parquet_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    W.drain(W.exact_late(stream, "k", "t", "seq", 100), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["seq"], r["start"]) for r in spark.read.parquet(str(tmp_path / "out")).where("is_late").collect()}
    want = set()
    for k in ("a", "b"):
        late = timewin.tumbling_with_late(df.where(F.col("k") == k), "t", "seq", 100).where("is_late")
        want |= {(r["seq"], r["start"]) for r in late.collect()}
    assert got == want == {(3, 0), (6, 0)}


def test_tumbling_and_sliding(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "seq bigint, t bigint, k string").select(F.timestamp_millis(F.col("t") * 1000).alias("at"), "k", "seq")
    df.write.parquet(str(tmp_path / "in"))
    for name, run in (("tumbling", lambda s: W.tumbling(s, "at", "100 seconds", ["k"], n=F.count("*"))), ("sliding", lambda s: W.sliding(s, "at", "300 seconds", "100 seconds", ["k"], n=F.count("*")))):
        batch = {tuple(r) for r in run(df).collect()}
        q = run(W.parquet_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table(name).collect()} == batch


def test_retries_and_dead_letters(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("not yet")
        return x + 1

    assert W.attempt(flaky, 1) == {"ok": True, "value": 2, "error": None, "attempts": 3}
    assert W.attempt(lambda x: 1 / x, 0, retries=2) == {"ok": False, "value": None, "error": "ZeroDivisionError: division by zero", "attempts": 3}
    assert W.attempt(lambda x: 1 / x, 0, retry=lambda e: False)["attempts"] == 1
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 2), (4, 0)], "id int, x int")
    got = {r["id"]: (r["result"]["ok"], r["result"]["value"]) for r in W.scored(df, "x", lambda x: 10 // x, "bigint", retries=0).collect()}
    assert got == {1: (True, 5), 2: (False, None), 3: (True, 5), 4: (False, None)}


def test_shards(spark, tmp_path):
    for k in ("one", "two"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "rows.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": "y"}]')
        spark.range(3).withColumn("b", F.lit(k)).coalesce(1).write.parquet(str(tmp_path / k / "rows.parquet"))
    assert sorted((r["shard"], r["a"]) for r in json_shards(spark, str(tmp_path), "rows.json", "a int, b string").collect()) == [("one", 1), ("one", 2), ("two", 1), ("two", 2)]
    assert parquet_shards(spark, str(tmp_path), "rows.parquet/*.parquet", ["id"]).columns == ["id", "shard"]


def test_polled_source(spark):
    df = polled(spark, "counting", "n bigint", lambda s: ([(k,) for k in range(s["at"], min(s["at"] + 3, 8))], {"at": min(s["at"] + 3, 8)}), {"at": 0})
    q = df.writeStream.format("memory").queryName("counted").start()
    try:
        for _ in range(10):
            q.processAllAvailable()
            if spark.table("counted").count() == 8:
                break
        assert sorted(r["n"] for r in spark.table("counted").collect()) == list(range(8))
    finally:
        q.stop()
