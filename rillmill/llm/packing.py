"""Packing documents into fixed windows by best-fit decreasing.

Best fit depends on lengths only, and there are at most ``window`` different
lengths. So the plan is made for the histogram of lengths: runs of windows with the same remaining
capacity are filled together, and a segment tree over remaining capacities
finds the tightest one that an item fits. The outcome is the one of
the item-by-item algorithm over all documents, while the driver sees a
histogram of bounded size. Documents then look up their window by their place
among those of the same length.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillmill.llm.shared import cut, sheltered
from rillmill.llm.textnum import Chars, chunks

WINDOW = 2048
_BUCKETS = 4096


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many windows are open at each; the least capacity >= x that has any."""

    def __init__(self, size: int):
        self.n = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, at: int, by: int) -> None:
        at += self.n
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.n
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.n:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.n
            at >>= 1
        return None


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first item, items, first window, items a window, offset in the window) for runs of items of one length.

    Item k of the run, from 0, goes to window first + k // q at offset + (k % q) * length.
    Among windows of the same remaining capacity the one opened or changed first is taken.
    """
    tree, open_runs = CapacityTree(window), {}
    out, opened = [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if count:
            open_runs.setdefault(capacity, deque()).append((first, count))
            tree.add(capacity, count)

    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            capacity = tree.tightest(length)
            if capacity is None:
                q = window // length
                need = -(-(total - done) // q)
                put(window, opened, need)
                opened += need
                continue
            q = capacity // length
            first, count = open_runs[capacity].popleft()
            tree.add(capacity, -count)
            full = min(count, (total - done) // q)
            if full:
                out.append((length, done, full * q, first, q, window - capacity))
                done += full * q
                put(capacity - q * length, first, full)
            rest = 0
            if full < count and done < total:  # fewer items are left than fit the next window
                rest = total - done
                out.append((length, done, rest, first + full, rest, window - capacity))
                done = total
                put(capacity - rest * length, first + full, 1)
            left = count - full - bool(rest)
            if left:  # back at the front: these windows are older than any that came since
                open_runs.setdefault(capacity, deque()).appendleft((first + full + bool(rest), left))
                tree.add(capacity, left)
    return out


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and _n, the number of white-space separated words of text; a null text has none."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).withColumn("_n", F.lit(0).cast("bigint")).schema

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text")).to_pylist()
            n = np.zeros(len(texts), dtype=np.int64)
            for lo, hi in chunks(texts):
                ch = Chars(texts[lo:hi], lower=False)
                ws = ch.spaces()
                start = ~ws
                start[1:] &= ws[:-1]
                inner = ch.off[:-1][np.diff(ch.off) > 0]
                start[inner] = ~ws[inner]
                n[lo:hi] = np.round(ch.sums(start))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(n)], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def ranked(items: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """items with _rank, the place of each row among those of the same key, from 0, by a hash of the order columns, then by these.

    Two levels: rows are numbered within hash ranges, whose sizes are then
    added up, so that a frequent key is spread over many tasks.
    """
    bucket = F.pmod(F.shiftrightunsigned(F.xxhash64(*order), 40), F.lit(_BUCKETS)).cast("int")
    items = items.withColumn("_b", bucket)
    sizes = items.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    out = items.withColumn("_place", place).join(sizes, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return out.withColumn("_rank", F.col("_place") + F.col("_before")).drop("_b", "_k", "_kb", "_place", "_before")


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_id, window_offset, doc_id, doc_offset, n_tokens): where each stretch of each document goes; tokens are white-space separated words.

    A document longer than a window is first cut into full windows, whose ids
    are negative; what remains is packed with the others by best-fit
    decreasing into windows numbered from 0. Every token of every row is
    placed once. Null, empty and blank texts have no tokens and no row. Rows
    that repeat are packed each; null ids are carried through. Ties: of windows with
    equal room the oldest run is taken; documents of one length come in
    an order by hash of id. An empty table gives an empty result. Columns beside doc_id and text
    are not read, whatever their names.
    """
    spark, docs = docs.sparkSession, sheltered(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    size = F.lit(window)
    counted = cut(word_counts(docs, ["doc_id"]).where("_n > 0"))
    counted = counted.select("doc_id", F.col("_n"), (F.col("_n") % size).alias("_l"))
    full = counted.where(F.col("_n") >= size)
    pieces = full.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_n") / size) - 1)).alias("_i"))
    wid = -1 - F.monotonically_increasing_id()
    full_rows = pieces.select(wid.alias("window_id"), F.lit(0).cast("bigint").alias("window_offset"), "doc_id", (F.col("_i") * size).alias("doc_offset"), size.cast("bigint").alias("n_tokens"))
    rest = counted.where("_l > 0")
    histogram = {r["_l"]: r["c"] for r in rest.groupBy("_l").agg(F.count("*").alias("c")).collect()}
    steps = plan(histogram, window)
    runs: dict[int, list] = {}
    for length, item, n, first, q, offset in steps:
        runs.setdefault(length, []).append((item, first, q, offset))
    table = spark.createDataFrame([(k, v) for k, v in runs.items()] or [], "_k bigint, _runs array<struct<item:bigint, first:bigint, q:bigint, at:bigint>>")
    placed = ranked(rest, "_l", [F.col("doc_id"), F.col("_n")]).join(table, F.col("_l") == F.col("_k"))
    run = F.element_at(F.filter("_runs", lambda r: r["item"] <= F.col("_rank")), -1)
    placed = placed.select("doc_id", "_n", "_l", "_rank", run.alias("_r"))
    k = F.col("_rank") - F.col("_r.item")
    packed = placed.select(
        (F.col("_r.first") + F.floor(k / F.col("_r.q"))).cast("bigint").alias("window_id"),
        (F.col("_r.at") + (k % F.col("_r.q")) * F.col("_l")).cast("bigint").alias("window_offset"),
        "doc_id",
        (F.col("_n") - F.col("_l")).alias("doc_offset"),
        F.col("_l").alias("n_tokens"),
    )
    return packed.unionByName(full_rows)
