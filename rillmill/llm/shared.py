"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves in local mode (tests); on a
    cluster that would be one machine's disk, so it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="rillmill-")
    return "file://" + _own[app]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and the loss of an executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillmill/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # rows may be wide, and a writer holds a whole row group
    out = spark.read.schema(df.schema).parquet(path)
    out._rillmill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_rillmill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def lean(run: Callable) -> Callable:
    """An Arrow function that gives the worker's free memory back to the machine when its task ends, as the worker lives on, idle, beside later stages."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(df: DataFrame, own: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """df with every column but ``own`` renamed by place, so that no other name can clash with the ones an operator uses.

    A column is its namesake in ``own``, or the first that differs by case only. ``toDF(*df.columns)`` gives the names back.
    """
    place = {}
    for name in own:
        same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
        if same:
            place[same[0]] = name
    return df.toDF(*(place.get(i, f"__other{i}") for i in range(len(df.columns))))
