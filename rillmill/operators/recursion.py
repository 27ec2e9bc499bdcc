"""Trees and lineage graphs over flat edge tables, and driver loops over DataFrames.

Trees are walked by path doubling: after k rounds every node knows its nearest 2^k
ancestors, so the number of joins grows with the logarithm of the depth. What a
round leaves is written by ``checkpoint`` to the session's checkpoint folder.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WALKED = 2048  # targets whose lineage a task walks at once


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if it wasn't: spark.checkpoint.dir; in local mode without one, a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="rillmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def paths(nodes: DataFrame, id_: str = "id", parent: str = "parent", go_on: Column | None = None) -> DataFrame:
    """(id, path): the ancestors of each node, nearest first.

    The walk ends at a node without parent, at a parent that isn't in the table, and, if given, at
    a node for which ``go_on`` isn't true. Ids are unique; cycles are an error, found when paths outgrow the table.
    """
    keep = F.col(parent) if go_on is None else F.when(go_on, F.col(parent))
    step = nodes.select(F.col(id_).alias("_i"), keep.alias("_up"))
    known = step.select(F.col("_i").alias("_k"))
    step = step.join(known, F.col("_up") == F.col("_k"), "left").select("_i", F.when(F.col("_k").isNotNull(), F.array("_up")).otherwise(F.array().cast("array<bigint>")).alias("_path"))
    size, done, total = 1, cut(step), None
    while True:
        open_ = done.where(F.size("_path") == size)
        if open_.isEmpty():
            return done.select(F.col("_i").alias(id_), F.col("_path").alias("path"))
        if total is None:
            total = nodes.count()
        if size > total:
            raise ValueError("the parents form a cycle")
        more = done.select(F.col("_i").alias("_j"), F.col("_path").alias("_more"))
        longer = open_.join(more, F.element_at("_path", -1) == F.col("_j")).select("_i", F.concat("_path", "_more").alias("_path"))
        done, size = cut(done.where(F.size("_path") < size).unionByName(longer)), 2 * size


def subtree_sizes(tree: DataFrame, id_: str = "id") -> DataFrame:
    """(id, size, height) of each node of ``paths``: nodes below it and itself, and the depth of the deepest below."""
    up = tree.select(F.posexplode(F.concat(F.array(id_), "path")).alias("_d", "_a"))
    return up.groupBy(F.col("_a").alias(id_)).agg(F.count("*").alias("size"), F.max("_d").alias("height"))


def lineage(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id) of everything that targets come from, themselves included; edges are (id, source).

    A frontier goes back one step a round without what it has already seen, so shared
    ancestors of a target are walked once.
    """
    front = cut(targets.select(F.col("id").alias("target"), F.col("id").alias("id")).distinct())
    seen = front
    while True:
        back = front.join(edges, "id").select("target", F.col("source").alias("id")).distinct()
        front = cut(back.join(seen, ["target", "id"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)  # each round's rows are written once


def _walked(ids: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, least, sum) of what each of the sorted targets comes from, itself included; edges are sorted by id."""
    low = min(int(targets.min()), int(sources.min()) if len(sources) else 1 << 62)
    width = max(int(targets.max()), int(sources.max()) if len(sources) else -(1 << 62)) - low + 1
    batch = max(1, min(WALKED, (1 << 62) // width))
    parts: list[list[np.ndarray]] = [[], [], []]
    for lo in range(0, len(targets), batch):
        some = targets[lo : lo + batch]
        front = np.arange(len(some)) * width + (some - low)  # target and id in one number
        seen = front
        while len(front):
            row, id_ = front // width, front % width + low
            first = np.searchsorted(ids, id_, "left")
            n = np.searchsorted(ids, id_, "right") - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            back = np.unique(np.repeat(row, n) * width + (sources[at] - low))
            place = np.minimum(np.searchsorted(seen, back), len(seen) - 1)
            front = back[seen[place] != back]
            seen = np.sort(np.concatenate([seen, front]), kind="stable")
        row, id_ = seen // width, seen % width + low
        begin = np.searchsorted(row, np.arange(len(some)))
        for part, x in zip(parts, (np.diff(np.append(begin, len(row))), id_[begin], np.add.reduceat(id_, begin))):
            part.append(x)
    return tuple(np.concatenate(p) for p in parts)


def lineage_figures(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, n, first, ids): how many rows of ``lineage`` each target has, with the least and the sum of their ids, whole numbers. No pair of target and id is ever stored.

    The edges are written once, sorted by id, to the shared checkpoint folder, and mapped from there into every task, which walks back for a batch
    of targets at a time: memory is that of a batch, disk that of the edges. Where the folder isn't a file system of the machines, lineage is used.
    """
    spark, distinct = targets.sparkSession, targets.select(F.col("id").cast("bigint").alias("id")).distinct()
    base = checkpoint_folder(spark)
    if urlparse(base).scheme not in ("", "file"):
        return lineage(edges, targets).groupBy("target").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("id").alias("ids"))
    at = os.path.join(urlparse(base).path, "rillmill", f"edges-{uuid.uuid4().hex}")
    os.makedirs(at)
    whole = edges.select(F.col("id").cast("bigint").alias("id"), F.col("source").cast("bigint").alias("source")).where("id is not null and source is not null")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = os.path.join(at, uuid.uuid4().hex)  # an attempt that is repeated leaves a file that nobody names
        n, lo, hi = 0, 0, 0
        with open(part + ".id", "wb") as i, open(part + ".source", "wb") as s:
            for b in batches:
                if len(b):
                    id_ = b.column(0).to_numpy()
                    n, lo, hi = n + len(b), lo if n else int(id_[0]), int(id_[-1])
                    i.write(id_.astype("<i8").tobytes())
                    s.write(b.column(1).to_numpy().astype("<i8").tobytes())
        if n:
            yield pa.RecordBatch.from_pydict({"part": [part], "lo": [lo], "hi": [hi], "n": [n]})

    parts = sorted(tuple(r) for r in whole.repartitionByRange("id").sortWithinPartitions("id", "source").mapInArrow(write, "part string, lo bigint, hi bigint, n bigint").select("lo", "hi", "part", "n").collect())
    for kind in ("id", "source"):  # one file of each, in order of ids
        with open(f"{at}/all.{kind}", "wb") as out:
            for _, _, part, _ in parts:
                with open(f"{part}.{kind}", "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
                os.remove(f"{part}.{kind}")
    total = sum(p[3] for p in parts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sources = (np.memmap(f"{at}/all.{k}", dtype="<i8", mode="r") if total else np.zeros(0, dtype=np.int64) for k in ("id", "source"))
        for b in batches:
            t = b.column(0).to_numpy()
            if len(t):
                n, first, sum_ = _walked(ids, sources, t)
                yield pa.RecordBatch.from_pydict({"target": pa.array(t), "n": pa.array(n), "first": pa.array(first), "ids": pa.array(sum_)})

    schema = "target bigint, n bigint, first bigint, ids bigint"
    none = distinct.where("id is null").select(F.col("id").alias("target"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("first"), F.col("id").alias("ids"))
    return distinct.where("id is not null").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(walk, schema).unionByName(none)


def spans(events: DataFrame) -> DataFrame:
    """(msg_id, step, began, ended, status): each receipt with the first success or failure after it in order; ``open`` if there is none."""
    closing = F.col("kind").isin("success", "failure")
    first = F.min(F.when(closing, F.struct("seq", "t", "kind")))
    out = events.groupBy("msg_id").agg(F.min(F.when(F.col("kind") == "recv", F.struct("seq", "t", "step"))).alias("_o"), first.alias("_c")).where("_o is not null")
    status = F.when(F.col("_c").isNull(), "open").when(F.col("_c.kind") == "success", "ok").otherwise("failed")
    return out.select("msg_id", F.col("_o.step").alias("step"), F.col("_o.t").alias("began"), F.col("_c.t").alias("ended"), status.alias("status"))


def iterate_until(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], measure: Callable[[DataFrame], dict], stops: dict[str, Callable[[dict, dict | None], bool]], most: int = 100, patience: int = 1) -> tuple[DataFrame, str, int]:
    """(state, reason, rounds): a driver loop. After each round ``measure`` sums the state up, and the first rule of ``stops`` that holds
    ends the loop; else ``turns`` ends it after ``most`` rounds, or ``plateau`` once the measure hasn't changed for ``patience`` rounds.
    """
    before, same = None, 0
    for k in range(1, most + 1):
        state = cut(step(state, k))
        now = measure(state)
        for reason, rule in stops.items():
            if rule(now, before):
                return state, reason, k
        same = same + 1 if now == before else 0
        if k < most and same >= patience:
            return state, "plateau", k
        before = now
    return state, "turns", most


def best_of(df: DataFrame, score: str, length: str, threshold: float) -> DataFrame:
    """The shortest row that reaches the threshold, or else the row of the highest score."""
    ok = F.col(score) >= threshold
    return df.orderBy(F.when(ok, 0).otherwise(1), F.when(ok, F.col(length)), F.desc(score), length).limit(1)
